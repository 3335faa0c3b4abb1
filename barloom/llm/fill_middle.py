"""Fill-in-middle documents: texts cut into units, and a prefix, middle and suffix that change places.

A text's units are the matches of a pattern, left to right; a cut lies after so many units. Where a cut lies in the text is
found relationally. Matches are exploded with their ordinals, running sums of their lengths are windows over a document's
ordinals, the cuts that documents request are joined and meet the match of their ordinal, and the offsets found are
aggregated per document, which then is cut by substrings. This is done at two levels: the first one's matches are blocks of
up to BLOCK units, so that a document gives one row for every BLOCK units, and the second level explodes only the blocks
that a cut lies in into units.

Documents are known by doc_id and a hash of their text: rows that share both are one document, collapsed before they are
moved. All steps share the partitioning by document, so texts are moved once, and those that stay plain not at all.

Defined results: null texts are empty; a null doc_id counts as an empty one; empty texts and texts with a marker in them
stay plain; what the pattern doesn't match behind the last unit belongs to the last part; repeated rows stay; only doc_id
and text are read, so other columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import let

#: A code point of any kind.
CODE_POINT = r"(?s)."
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units of a block, and the percentages of documents that are transformed, and of those that have their suffix first.
BLOCK = 128
TRANSFORMED, SUFFIX_FIRST = 90, 20


def _number(digest: Column, k: int) -> Column:
    """The k-th group of 8 hex digits (from 1), unsigned."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


#: What a document is known by: its doc_id (0 for none), and a hash of its text, its length and whether it has a doc_id.
_KEY = ["doc", "h"]


def requests(docs: DataFrame, unit: str = CODE_POINT) -> DataFrame:
    """_KEY, doc_id, text, n (units), form, and the cuts lo and hi (null if plain) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    length = F.length("text") if unit == CODE_POINT else F.regexp_count("text", F.lit(unit))
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    key = [F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc"), F.xxhash64("text", F.length("text"), F.col("doc_id").isNull()).alias("h")]
    told = own.select(*key, "doc_id", "text", length.cast("long").alias("n"), digest.alias("digest"))
    h = [_number(F.col("digest"), k) for k in (1, 2, 3, 4)]
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (h[2] % 100 >= TRANSFORMED)
    form = F.when(plain, "plain").when(h[3] % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    at = [F.when(~plain, x % (F.col("n") + 1)) for x in h[:2]]
    return told.select(*_KEY, "doc_id", "text", "n", form.alias("form"), F.least(*at).alias("lo"), F.greatest(*at).alias("hi"))


def cut_offsets(texts: DataFrame, cuts: DataFrame, unit: str = CODE_POINT, block: int = BLOCK) -> DataFrame:
    """_KEY, lo_chars, hi_chars: how many code points of the texts (_KEY, text) lie before the cuts (_KEY, lo, hi)."""
    flags = "(?s)" if unit.startswith("(?s)") else ""
    blocks = F.regexp_extract_all("text", F.lit(f"{flags}(?:{unit.removeprefix('(?s)')}){{1,{block}}}"), F.lit(0))
    matches = texts.select(*_KEY, F.posexplode(blocks).alias("ordinal", "match"))
    in_order = Window.partitionBy(*_KEY).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    placed = matches.withColumn("before", F.coalesce(F.sum(F.length("match")).over(in_order), F.lit(0)))
    # the match in which a cut's last unit is; a cut before all units has none, and its offset is 0
    last = [F.struct(F.lit(k).alias("which"), (F.col(c) - 1).alias("unit")) for k, c in enumerate(("lo", "hi"))]
    asked = placed.join(cuts, _KEY).select(*_KEY, "ordinal", "match", "before", F.explode(F.array(*last)).alias("cut"))
    asked = asked.filter("cut.unit >= 0").filter(F.floor(F.col("cut.unit") / block) == F.col("ordinal"))
    units = asked.select(*_KEY, "cut.which", "before", F.pmod("cut.unit", F.lit(block)).alias("rest"), F.posexplode(F.regexp_extract_all("match", F.lit(unit), F.lit(0))).alias("k", "unit"))
    in_block = Window.partitionBy(*_KEY, "which").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ends = units.withColumn("end", F.col("before") + F.sum(F.length("unit")).over(in_block)).filter("k = rest")
    return ends.groupBy(*_KEY).agg(*(F.max(F.when(F.col("which") == k, F.col("end"))).alias(c) for k, c in enumerate(("lo_chars", "hi_chars"))))


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT, block: int = BLOCK) -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars (null if plain) and output of every row of docs (doc_id, text).

    unit: a pattern whose matches follow each other without gaps, such as a code point, or a word with the space before it.
    """
    asked = requests(docs, unit)
    none = F.lit(None).cast("long")
    plain = asked.filter("form = 'plain'").select("doc_id", "text", "n", "form", none.alias("prefix_chars"), none.alias("middle_chars"), F.col("text").alias("output"))
    cut = asked.filter("form <> 'plain'")
    texts = cut.groupBy(*_KEY).agg(F.first("text").alias("text"))
    cuts = cut.groupBy(*_KEY).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    zero = F.lit(0).cast("long")
    lo, hi = F.coalesce("lo_chars", zero), F.coalesce("hi_chars", zero)
    whole = texts.join(cut_offsets(texts, cuts, unit, block), _KEY, "left").select(*_KEY, "text", lo.alias("lo_at"), hi.alias("hi_at"))
    # every row, without its text, meets its document
    told = cut.select(*_KEY, "doc_id", "n", "form").join(whole, _KEY)
    at = lambda c: F.col(c).cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), at("lo_at")), F.substring("text", at("lo_at") + 1, at("hi_at") - at("lo_at")), F.substring("text", at("hi_at") + 1, F.length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).otherwise(spm)
    return told.select("doc_id", "text", "n", "form", F.col("lo_at").alias("prefix_chars"), (F.col("hi_at") - F.col("lo_at")).alias("middle_chars"), output.alias("output")).union(plain)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the form was made of, from these two alone."""
    between = lambda text, a, b: F.substring_index(F.substring(text, F.lit(len(a) + 1), F.length(text)), b, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    # markers don't occur in parts, nor across the ends of parts
    suffix_of_psm, prefix_of_spm = (F.substring_index(F.substring_index(output, m, -1), MIDDLE, 1) for m in (SUFFIX, PREFIX))
    psm = F.concat(between(output, PREFIX, SUFFIX), middle, suffix_of_psm)
    spm = F.concat(prefix_of_spm, middle, between(output, SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(filled: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    told = let(F.col("output"), lambda o: F.struct(F.sha2(o, 256).alias("output_sha256"), F.sha2(restored(o, F.col("form")), 256).alias("restored_sha256")))
    return filled.select("doc_id", "n", "form", "prefix_chars", "middle_chars", told.alias("x")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "x.*")
