"""Document fingerprints by winnowing, with column functions only.

A token is a run of up to ``LONGEST`` = 16 visible characters of scripts with spaces, Cyrillic or Arabic as well as Latin; in a longer run
(a URL, base64, minified code) every 17 characters in a row are a token, one at each place, and a character of a script without
spaces is one. So tokens depend on the characters around them only, never on where a run began. The hash of ``GRAM`` = 3 tokens is a polynomial of
their hashes modulo 2^31 - 1, rolled on from that of the first two. The minima of ``WINDOW`` = 6 neighbouring hashes come from those of 2 and 4. A hash
is packed above its place counted backwards, so the least number of a window is the least hash, the rightmost one if there are
several. Kept are all chosen hashes with their places: texts that share ``GRAM + WINDOW - 1`` = 8 tokens in a row share a fingerprint
entry, so eight words, or 24 characters of an unspaced run at whatever offsets. Each step is a projection of its own over arrays, linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storegrain.session import stage

GRAM, WINDOW, LONGEST = 3, 6, 16
#: Visible characters of scripts with spaces (all but Thai, Lao, Myanmar, Khmer, kana and Han); ASCII is asked first. The last range is
#: written out because Java looks behind by code points only where the pattern itself holds one beyond U+FFFF.
SPACED = (r"[\x21-\x7E[\u00A1-\u0DFF\u0F00-\u0FFF\u10A0-\u167F\u1681-\u177F\u1800-\u1FFF\u2010-\u2027\u2030-\u205E\u2070-\u2E7F"
          r"\uAC00-\uD7A3\uFB00-\uFDFF\uFE70-\uFEFE" "\U00010000-\U0001FFFD]]")
SHORT = rf"(?<!{SPACED}){SPACED}{{1,{LONGEST}}}+(?!{SPACED})"
#: A whole short run, the next characters of a long one, or a single character of another script (no half of a surrogate pair); the next
#: search goes on behind a short run, else one place on.
TOKENS = rf"(?=({SHORT}|{SPACED}{{{LONGEST + 1}}}|(?!{SPACED})[^\s\p{{Z}}\p{{Cs}}]))(?:{SHORT})?+"
#: Base and modulus of the polynomial: a product of two values below the modulus fits a long.
BASE, MODULUS = 1_000_003, (1 << 31) - 1
LOW = (1 << 32) - 1
#: Rows of one partition of the sorted ids.
ID_ROWS = 2_000_000


def _pairs(name: str, step: int, join) -> Column:
    """``join`` of each element of an array column and the one ``step`` behind it; the last ``step`` elements go."""
    array = F.col(name)
    out = F.transform(array, lambda x, i: join(x, F.get(array, i + step)))
    return F.slice(out, 1, F.greatest(F.size(array) - step, F.lit(0)))


def winnow(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``name``: the chosen hashes of a text column (packed with their places), in order of place.

    A text with fewer than three tokens is one gram, one without tokens (or null) has an empty array; with up to six grams one
    is chosen. Equal texts have equal arrays.
    """
    a, b = f"__{name}_a", f"__{name}_b"
    rolled = lambda x, y: (x * F.lit(BASE).cast("long") + y) % F.lit(MODULUS).cast("long")
    packed = lambda x, i: F.shiftleft(x, 32).bitwiseOR(F.lit(LOW) - i)
    token = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKENS), F.lit(1))
    df = df.withColumn(a, F.transform(token, lambda t: F.xxhash64(t).bitwiseAND(F.lit(MODULUS).cast("long"))))
    df = df.withColumn(b, F.when(F.size(a) >= GRAM, _pairs(a, 1, rolled)).when(
        F.size(a) > 0, F.array(F.aggregate(a, F.lit(0).cast("long"), rolled))).otherwise(F.array().cast("array<bigint>")))
    two = F.col(b)
    df = df.withColumn(b, F.when(F.size(a) < GRAM, F.transform(two, packed)).otherwise(F.slice(
        F.transform(two, lambda x, i: packed(rolled(x, F.get(F.col(a), i + 2)), i)), 1, F.greatest(F.size(a) - GRAM + 1, F.lit(0))))).drop(a)
    few, all_grams = F.size(b) <= WINDOW, F.col(b)
    df = df.withColumn(a, F.when(few, F.filter(F.array(F.array_min(all_grams)), lambda x: x.isNotNull())).otherwise(
        _pairs(b, 1, F.least))).withColumn(b, few)
    for step in (2, 2):  # minima of 2, then of 4, then of 6
        df = df.withColumn(a, F.when(F.col(b), F.col(a)).otherwise(_pairs(a, step, F.least)))
    return df.withColumn(name, F.array_distinct(a)).drop(a, b)


def fingerprint_text(name: str) -> Column:
    """``place:hash`` of each entry, joined by spaces."""
    return F.array_join(F.transform(F.col(name), lambda v: F.concat(
        (F.lit(LOW) - v.bitwiseAND(F.lit(LOW))).cast("string"), F.lit(":"), F.lower(F.hex(F.shiftrightunsigned(v, 32))))), " ")


def hashes(name: str) -> Column:
    """The distinct hashes of a fingerprint, without places."""
    return F.array_distinct(F.transform(F.col(name), lambda v: F.shiftright(v, 32).cast("int")))


def likeness(one: Column, two: Column) -> Column:
    """Shared share of two sets of hashes; two empty ones are alike."""
    both, union = F.size(F.array_intersect(one, two)), F.size(F.array_union(one, two))
    return F.when(union == 0, 1.0).otherwise(both / union).cast("double")


def _before(docs: DataFrame) -> tuple[DataFrame, bool]:
    """For each id the one before it in descending order (the last one for the first) and half its length; whether ids repeat."""
    ids = docs.groupBy("id").agg(F.max("n_chars").alias("n"), F.count("*").alias("rows"))
    ids = stage(ids.select("id", F.floor(F.col("n") / 2).alias("half"), "rows"), "ids")
    total, most = ids.agg(F.count("*"), F.max("rows")).first()
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // ID_ROWS))
    ordered = stage(ids.repartitionByRange(parts, F.desc("id")).withColumn("part", F.spark_partition_id()), "ordered-ids")
    own = F.struct("id", "half")
    down = Window.partitionBy("part").orderBy(F.desc("id"))
    # one row for each part, so few in one task
    lasts = ordered.groupBy("part").agg(F.min(own).alias("last"))
    over = Window.orderBy("part")
    wrap = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lasts = lasts.select(F.col("part"), F.coalesce(F.lag("last").over(over), F.last("last").over(wrap)).alias("edge"))
    placed = ordered.withColumn("near", F.lag(own).over(down)).join(F.broadcast(lasts), "part")
    near = F.coalesce("near", "edge")
    return placed.select("id", near["id"].alias("before"), near["half"].alias("half")), (most or 0) > 1


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, a row for each row of ``docs``.

    The edited text is the text whose last floor(n/2) code points are replaced by the first as many (or all) of the next
    document in descending order of the id, after the last one the first. Only half of each text moves to its neighbour.

    Null texts are empty. Rows with a null id have no next document: their edited text is their first half, and ``near_next`` compares
    with an empty text. If an id repeats, each of its rows stays, and the smallest text of that id is the next document of
    others. Other columns are not looked at; without rows the result is empty.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = source.where(F.col("id").isNotNull())
    order, repeats = _before(known.select("id", F.char_length("text").alias("n_chars")))
    moved = winnow(known.join(order, "id"), "text", "print").select(
        F.col("before").alias("id"), F.substring(F.col("text"), F.lit(1), F.col("half").cast("int")).alias("next_text"),
        hashes("print").alias("next_hashes"), *([F.col("text").alias("whole")] if repeats else []))
    if repeats:
        moved = moved.groupBy("id").agg(F.min(F.struct("whole", "next_text", "next_hashes")).alias("m")).select("id", "m.next_text", "m.next_hashes")
    single = source.where(F.col("id").isNull()).withColumns({
        "next_text": F.lit(""), "next_hashes": F.array().cast("array<int>")})
    rows = known.join(moved, "id").unionByName(single).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2)
    rows = rows.withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half.cast("int"))))
    rows = winnow(winnow(rows.drop("next_text"), "text", "print"), "edited", "edited_print")
    return rows.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_text("print").alias("fingerprint"), fingerprint_text("edited_print").alias("edited_fingerprint"),
        likeness(hashes("print"), hashes("edited_print")).alias("near_edited"),
        likeness(hashes("print"), F.col("next_hashes")).alias("near_next"))
