"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

One scan finds the base spans (assignments, access keys, hex keys) and further candidates: long mixed tokens with no
keyword beside them. Hashes of all their values are aggregated over the corpus by distinct owner and by distinct repository
(a repository belongs to an owner), combined on the map side. A value under few owners and in few repositories is
owner-specific, one that many have is a widely copied example; so is one that a single hot owner has all over its
repositories. A candidate that is owner-specific becomes a span of kind ``owned``, a copied one does not. Base spans stay
whatever their frequency is; every span's counts and verdict are reported. Texts are not shuffled: the scan is written out as
offsets and hashes.

Each pattern is looked for once in every text; offsets are worked out only where it is found. They come without Python: a
split by the pattern gives the lengths between matches, the matches give theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import packed, quoted, sieve, stash, text_of, unpacked

#: Fixed values of the contract: kinds in their order, with patterns. Runs long enough are written as such where that
#: finds the same matches; an assignment is matched at any length and dropped afterwards if its value is too short.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: What the method looks at besides.
MIXED = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
SPAN = "array<struct<start:int,ord:int,stop:int,h:bigint>>"
#: Matches whose offsets are summed up in one inner fold. Two levels keep the cost of many matches far from their square.
FOLD = 256


def _matches(text: Column, pattern: str, kind: int, value: int = 0, guard: Column | None = None) -> Column:
    """Array of (start, ord, stop, value) for the leftmost non-overlapping matches; offsets in code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    both = F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap"))
    one = "struct<start:int,ord:int,stop:int,value:string>"
    none = F.array().cast(f"array<{one}>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + F.char_length(x["hit"])
        what = x["hit"] if not value else F.regexp_extract(x["hit"], pattern, value)
        span = F.struct(start.alias("start"), F.lit(kind).alias("ord"), stop.alias("stop"), what.alias("value"))
        return F.struct(stop.alias("at"), F.concat(acc["got"], F.array(span)).alias("got"))

    def block(acc: Column, i: Column) -> Column:
        inner = F.aggregate(F.slice(both, i * FOLD + 1, F.lit(FOLD)), F.struct(acc["at"].alias("at"), none.alias("got")), add)
        return F.struct(inner["at"].alias("at"), F.concat(acc["all"], F.array(inner["got"])).alias("all"))

    blocks = F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / FOLD).cast("int"))
    found = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{one}>>").alias("all")), block, lambda acc: F.flatten(acc["all"]))
    return F.when(text.rlike(pattern) if guard is None else guard & text.rlike(pattern), found).otherwise(none)


def _hashed(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["stop"].alias("stop"), F.xxhash64(s["value"]).alias("h")))


def _live_looking(value: Column) -> Column:
    """Letters and at least three digits, ten or more distinct characters: what a word, a number or a filler isn't."""
    return value.rlike("[A-Za-z]") & value.rlike("[0-9].*[0-9].*[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= 10)


def spans_text(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["ord"] + 1), s["start"], s["stop"])))


def scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str | None, repo_col: str | None) -> DataFrame:
    """(row, doc_id, text_hash, owner, repo, base, more): the spans of every row, without its text."""
    named = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), text_of(text_col).alias("t"), named(owner_col).alias("owner"), named(repo_col).alias("repo"))
    text = F.col("t")
    long_enough = F.filter(_matches(text, ASSIGN, 0, value=1), lambda s: F.char_length(s["value"]) >= 8)
    digits = text.rlike("[0-9][A-Za-z+/_-]*[0-9]")  # every live-looking value has that
    found = rows.select(
        "doc_id", "owner", "repo", F.xxhash64("doc_id", "t").alias("text_hash"),
        F.concat(long_enough, _matches(text, ACCESS, 1, guard=text.contains("AKIA")), _matches(text, HEX, 2)).alias("base"),
        F.filter(_matches(text, MIXED, 3, guard=digits), lambda s: _live_looking(s["value"])).alias("mixed"),
    )
    apart = F.filter("mixed", lambda m: ~F.exists("base", lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"])))
    found = found.withColumn("more", _hashed(apart)).withColumn("base", _hashed(F.array_sort("base"))).drop("mixed")
    return stash(found.withColumn("row", F.monotonically_increasing_id()), "spans")


def ownership(found: DataFrame) -> DataFrame:
    """(h, owners, repos) of every value hash: distinct owners, and distinct repositories over all owners. A missing name counts as one."""
    uses = found.select(F.explode(F.concat("base", "more")).alias("s"), "owner", "repo").select("s.h", "owner", "repo").distinct()
    by_owner = uses.groupBy("h", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("h").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = "lang",
    max_owners: int = 2, max_repos: int = 3,
) -> DataFrame:
    """Spans of every row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, verdicts, n_owned, n_copied, text_hash.

    Null text counts as empty and has no spans. A span is kind:start:end of the whole match, code points, end
    exclusive. ``spans`` are the base spans and the candidates under at most ``max_owners`` owners and in at most
    ``max_repos`` repositories (kind ``owned``, ``n_owned`` of them). ``verdicts`` has kind:start:end:owners:repositories:verdict
    of base spans and of all candidates, with ``specific`` or ``copied``; ``n_copied`` counts the copied ones. A table
    without one of the two columns has one owner or repository for all rows. Equal rows get equal results, an empty table gives none,
    other columns are ignored.
    """
    found = scan(docs, id_col, text_col, owner_col, repo_col)
    freq = stash(ownership(found), "owners")
    used = found.select("row", F.explode(F.concat("base", "more")).alias("s")).select("row", "s.*")
    copied = (F.col("owners") > max_owners) | (F.col("repos") > max_repos)
    span = F.struct("start", "ord", "stop", "h")
    told = used.join(freq, "h").groupBy("row").agg(
        F.collect_list(F.when((F.col("ord") == 3) & ~copied, span)).alias("owned"), F.count_if(copied).alias("n_copied"),
        F.collect_list(F.struct("start", "ord", "stop", "owners", "repos", copied.alias("copied"))).alias("told"),
    )
    none = F.array().cast(SPAN)
    all_ = found.join(told, "row", "left").withColumn("owned", F.coalesce(F.col("owned").cast(SPAN), none))
    all_ = all_.withColumn("spans", F.array_sort(F.concat("base", "owned")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["ord"] == kind)).cast("long")
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["ord"] + 1)
    verdict = lambda s: F.concat_ws(":", kind(s), s["start"], s["stop"], s["owners"], s["repos"], F.when(s["copied"], "copied").otherwise("specific"))
    return all_.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
        F.coalesce(F.concat_ws(",", F.transform(F.array_sort("told"), verdict)), F.lit("")).alias("verdicts"),
        F.size("owned").cast("long").alias("n_owned"), F.coalesce("n_copied", F.lit(0).cast("long")).alias("n_copied"), "text_hash",
    )


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", **columns) -> DataFrame:
    """The documents with every span replaced by ``mask``, overlapping spans by one; all rows and columns stay.

    ``n_chars`` follows the text where the table has it. Rows without spans, null texts included, come back unchanged and are not
    shuffled; repeated rows and rows without an id are masked each by their own text. An empty table gives no rows, and
    columns of any name come back as they were. ``columns`` are those of find_secrets().
    """
    dirty = find_secrets(docs, id_col, text_col, **columns).where("spans <> ''").select("doc_id", "text_hash", "spans").distinct()
    dirty = stash(dirty, "dirty")
    text = text_of(text_col)
    rows = sieve(packed(docs, t=text, text_hash=F.xxhash64(F.col(quoted(id_col)), text)), "text_hash", dirty.select("text_hash"))
    same = [F.col("r.text_hash") == F.col("s.text_hash"), F.col("r.d").getField(id_col).eqNullSafe(F.col("s.doc_id"))]
    both = rows.where("maybe").alias("r").join(dirty.alias("s"), same, "left").select("r.d", "r.t", "s.spans")
    spans = F.transform(F.split("spans", ","), lambda s: F.transform(F.slice(F.split(s, ":"), 2, 2), lambda n: n.cast("int")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.col("t").substr(acc["at"] + 1, F.greatest(s[0] - acc["at"], F.lit(0)))
        parts = F.when(s[0] >= acc["at"], F.concat(acc["parts"], F.array(gap, F.lit(mask)))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s[1]).alias("at"), parts.alias("parts"))

    rest = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.col("t").substr(acc["at"] + 1, F.char_length("t")))
    both = both.withColumn("masked", F.when(F.col("spans").isNotNull(), F.aggregate(spans, start, add, rest)))
    kinds = dict(docs.dtypes)
    new = {text_col: F.coalesce("masked", F.col("d").getField(text_col)).cast(kinds[text_col])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("masked").isNull(), F.col("d").getField("n_chars")).otherwise(F.char_length("masked").cast(kinds["n_chars"]))
    masked = both.select(*[new.get(c, F.col("d").getField(c)).alias(c) for c in docs.columns])
    return unpacked(rows.where("not maybe"), docs).unionByName(masked)
