"""Document fingerprints that add up: a homomorphic multiset hash over paragraphs, in DataFrame functions only.

A paragraph (a line with a character that isn't white space) is hashed to a wide vector, and a text's fingerprint is the sum
of the vectors of its paragraphs, lane by lane modulo 2^32. So paragraphs may come in any order, and one
is inserted or deleted by adding or subtracting its vector. The vector has two kinds of lanes:

* ``LANES`` lanes of 32 bits from the paragraph's SHA-512. They make texts with unlike multisets of paragraphs unlike;
* ``MARKS`` lanes of signs: each distinct window of three words of the paragraph (shorter ones at its start) adds 1 or -1 to one of them, both
  picked by its hash. The inner product of two such vectors estimates that of the texts' windows, with an error of about
  1 / sqrt(MARKS) of their lengths; their cosine, cut at 0, is the likeness.

Lanes of signs are read as signed, so the likeness holds for texts of up to 2^31 windows; equality holds for all.

Plan. The edited text needs a neighbour's text. Rows are dealt into ranges by descending id once and written
out in order, which numbers them without a window; blocks of BLOCK rows are shuffled, with the first row of the next block as a guest,
so a window never holds more than BLOCK + 1 rows whatever the ids are. What comes after (edit, hashing, sums by lane, neighbour's
fingerprint) stays in the block's task: sums are grouped by the block, its partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import SPACES, quoted, stash, text_of

#: Lanes from the digest (64 bytes) and lanes of signs; a lane has 32 bits.
LANES, MARKS = 16, 128
MODULUS = 1 << 32
#: Rows that are shuffled together in the order of ids.
BLOCK = 64


def units(rows: DataFrame, text: str, dense: Column | None = None) -> DataFrame:
    """The rows without ``text``, one for each thing that its paragraphs add to a lane: ``__lane`` and ``__value``.

    A text without a paragraph adds 0 to the lanes of digests. Where ``dense`` holds, rows that add 0 come for all other lanes too.
    """
    lines = rows.select("*", F.posexplode(F.split(text, "\n")).alias("__line", "__p")).drop(text)
    words = F.split(F.nullif(F.btrim("__p", F.lit(SPACES)), F.lit("")), r"[\x20\x09-\x0D]+")
    lines = lines.withColumn("__w", words).withColumn("__sha", F.when(F.col("__w").isNotNull(), F.sha2(F.col("__p").cast("binary"), 512)))
    digest = [F.coalesce(F.conv(F.substring("__sha", 8 * i + 1, 8), 16, 10).cast("long"), F.lit(0)) for i in range(LANES)]
    before = [F.concat(F.array_repeat(F.lit(None).cast("string"), k), "__w") for k in (1, 2)]
    window = lambda z: F.shiftrightunsigned(F.xxhash64(z["1"], z["2"], z["__w"]), 1)
    none = F.array().cast("array<bigint>")
    windows = F.coalesce(F.array_distinct(F.transform(F.slice(F.arrays_zip("__w", *before), 1, F.size("__w")), window)), none)
    others = F.when(F.col("__line") == 0, F.sequence(F.lit(-MARKS).cast("long"), F.lit(-1).cast("long"))).otherwise(none)
    others = F.lit(None) if dense is None else F.when(dense, others)
    kept = [F.col(quoted(c)) for c in lines.columns if c not in ("__line", "__p", "__w", "__sha")]
    each = lines.select(*kept, F.posexplode(F.concat(F.array(*digest), windows, F.coalesce(others, none))).alias("__at", "__h"))
    picked = F.col("__h") % MARKS + LANES
    lane = F.when(F.col("__at") < LANES, F.col("__at")).when(F.col("__h") < 0, F.col("__h") + LANES + MARKS).otherwise(picked).cast("int")
    sign = F.when(F.col("__h").bitwiseAND(F.lit(1 << 40)) == 0, 1).otherwise(-1)
    value = F.when(F.col("__at") < LANES, F.col("__h")).when(F.col("__h") < 0, F.lit(0)).otherwise(sign)
    return each.select(*kept, lane.alias("__lane"), value.cast("long").alias("__value"))


def paragraph_vectors(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, ``vector``): the sum of the vectors of all paragraphs of a group's texts, LANES + MARKS residues modulo 2^32.

    ``text`` may not be null. A group without a paragraph has the zero vector.
    """
    sums = units(rows.select(*keys, text), text, F.lit(True)).groupBy(*keys, "__lane").agg(F.sum("__value").alias("__s"))
    lanes = F.array_sort(F.collect_list(F.struct("__lane", "__s")))["__s"]
    return sums.groupBy(*keys).agg(lanes.alias("vector")).withColumn("vector", F.transform("vector", _residue))


def _residue(x: Column) -> Column:
    return F.pmod(x, F.lit(MODULUS))


def zero() -> Column:
    return F.array_repeat(F.lit(0).cast("long"), LANES + MARKS)


def insert(vector: Column, more: Column) -> Column:
    """The vector of a text after paragraphs with the sum ``more`` came to it."""
    return F.zip_with(vector, more, lambda x, y: _residue(x + y))


def delete(vector: Column, less: Column) -> Column:
    """The vector of a text after paragraphs with the sum ``less`` have left it."""
    return F.zip_with(vector, less, lambda x, y: _residue(x - y))


def encode(vector: Column) -> Column:
    """The vector as a string: base64 of its lanes, 4 bytes each."""
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(x), 8, "0")), ""))), "\r\n", "")


def decode(fingerprint: Column) -> Column:
    """The vector of a string made by encode()."""
    digits = F.hex(F.unbase64(fingerprint))
    return F.transform(F.sequence(F.lit(0), F.lit(LANES + MARKS - 1)), lambda i: F.conv(F.substr(digits, 8 * i + 1, F.lit(8)), 16, 10).cast("long"))


def _signed(vector: Column) -> Column:
    return F.transform(F.slice(vector, LANES + 1, MARKS), lambda x: F.when(x >= MODULUS // 2, x - MODULUS).otherwise(x).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _cosine(same: Column, dot: Column, aa: Column | str, bb: Column | str) -> Column:
    size = F.sqrt(aa) * F.sqrt(bb)
    return F.when(same, F.lit(1.0)).when(size == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot / size)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two vectors: 1 for equal ones, else the cosine of the lanes of signs, 0 where it is negative or one has no paragraph."""
    x, y = _signed(a), _signed(b)
    return _cosine(a == b, _dot(x, y), _dot(x, x), _dot(y, y))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, vector, fingerprint) of every row, whole texts.

    Null texts count as empty; a text without a paragraph has the zero vector. Rows are kept one by one, with equal ids or none
    too; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = stash(docs.select(F.col(quoted(id_col)).alias("doc_id"), text_of(text_col).alias("__t")).withColumn("__row", F.monotonically_increasing_id()), "texts")
    rows = rows.withColumn("n_chars", F.char_length("__t").cast("long"))
    vectors = paragraph_vectors(rows, ["__row", "doc_id", "n_chars"], "__t")
    return vectors.select("doc_id", "n_chars", "vector", encode(F.col("vector")).alias("fingerprint"))


def in_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, __t, __block, __pos, __guest): rows numbered by descending id, blocks of BLOCK of them, and in each the first row after it.

    The row after the last is the first. Rows without an id come last; equal ids are ordered by a hash of their text.
    """
    spark, text = docs.sparkSession, text_of(text_col)
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), text.alias("__t"), F.xxhash64(text).alias("__x"), F.monotonically_increasing_id().alias("__u"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("__x"), F.col("__u")]  # __u lets a hot id fill many ranges
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "__t", F.monotonically_increasing_id().alias("__at"))
    dealt = stash(dealt, "ordered")  # written, the place in the sorted ranges is fixed
    part = F.shiftrightunsigned("__at", 33)
    sizes = sorted(dealt.groupBy(part.alias("p")).count().collect())  # a row for each range
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    starts = spark.createDataFrame(starts, "__p long, __start long")
    rows = dealt.join(F.broadcast(starts), part == F.col("__p")).withColumn("__pos", F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    place = lambda block, pos, guest: F.struct(block.cast("long").alias("__block"), pos.alias("__pos"), F.lit(guest).alias("__guest"))
    own, last = F.expr(f"__pos div {BLOCK}"), -(-max(total, 1) // BLOCK) - 1
    before = F.when(F.col("__pos") == 0, place(F.lit(last), F.lit(total).cast("long"), True)).otherwise(place(own - 1, F.col("__pos"), True))
    places = F.when(F.col("__pos") % BLOCK == 0, F.array(place(own, F.col("__pos"), False), before)).otherwise(F.array(place(own, F.col("__pos"), False)))
    return rows.select("doc_id", "__t", F.explode(places).alias("__q")).select("doc_id", "__t", "__q.*")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as many, or all, of the first of the next
    row's in descending id (after the last: the first). Its fingerprint comes incrementally: paragraphs up to the
    cut are kept, those after it deleted, those of the edited text after it inserted. ``near_edited`` and ``near_next``: likeness of
    the fingerprint to the edited text's and to the next row's.

    Null texts count as empty, rows without an id come last, equal ids are ordered by a hash of their text, equal rows are rows of their own;
    a single row is its own next. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = in_blocks(docs, id_col, text_col)
    order = Window.partitionBy("__block").orderBy("__pos")
    rows = rows.withColumn("__next", F.coalesce(F.lead("__t").over(order), F.lit(""))).withColumn("n_chars", F.char_length("__t").cast("long"))
    cut = F.expr("cast(n_chars - n_chars div 2 as int)")
    rows = rows.withColumn("__head", F.substr("__t", F.lit(1), cut)).withColumn("__new", F.concat("__head", F.substr("__next", F.lit(1), F.expr("cast(n_chars div 2 as int)"))))
    kept = F.char_length("__head") - F.char_length(F.substring_index("__head", "\n", -1))  # up to the last end of a line before the cut
    rest = lambda c: F.substr(c, F.col("__kept") + 1, F.char_length(c))
    rows = rows.withColumn("__kept", kept).select(
        "__block", "__pos", "__guest", "doc_id", "n_chars", F.unhex(F.sha2(F.col("__new").cast("binary"), 256)).alias("__sha256"),
        F.array(F.substr("__t", F.lit(1), F.col("__kept")), rest("__t"), rest("__new")).alias("__texts"),
    )
    keys = ["__block", "__pos", "__guest", "doc_id", "n_chars", "__sha256"]
    parts = rows.select(*keys, F.posexplode("__texts").alias("__part", "__text"))
    # part 0 is kept, part 1 deleted, part 2 inserted: the old sum is 0 + 1, the edited one takes part 1 out and adds part 2
    old = F.sum(F.when(F.col("__part") < 2, F.col("__value")).otherwise(0))
    change = F.sum(F.when(F.col("__part") == 1, -F.col("__value")).when(F.col("__part") == 2, F.col("__value")).otherwise(0))
    sums = units(parts, "__text", F.col("__part") == 0).groupBy(*keys, "__lane").agg(old.alias("o"), (old + change).alias("e"))
    signs = lambda x: F.sum(F.when(F.col("__lane") >= LANES, x.cast("double")))
    o, e = F.col("o"), F.col("e")
    whole = sums.groupBy(*keys).agg(
        signs(o * e).alias("__oe"), signs(o * o).alias("__oo"), signs(e * e).alias("__ee"), F.bool_and(_residue(o) == _residue(e)).alias("__same"),
        F.array_sort(F.collect_list(F.struct("__lane", "o", "e"))).alias("__v"),
    ).withColumn("__o", F.col("__v")["o"])
    whole = whole.withColumns({"__after": F.lead("__o").over(order), "__aa": F.lead("__oo").over(order)}).where("not __guest")
    on = _dot(*[F.transform(F.slice(c, LANES + 1, MARKS), lambda x: x.cast("double")) for c in ("__o", "__after")])
    text = lambda c: encode(F.transform(c, _residue))
    return whole.select(
        "doc_id", "n_chars", F.lower(F.hex("__sha256")).alias("edited_sha256"), text(F.col("__o")).alias("fingerprint"), text(F.col("__v")["e"]).alias("edited_fingerprint"),
        _cosine(F.col("__same"), F.col("__oe"), "__oo", "__ee").alias("near_edited"), _cosine(F.col("__o") == F.col("__after"), on, "__oo", "__aa").alias("near_next"),
    )
