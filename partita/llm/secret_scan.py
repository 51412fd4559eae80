"""Secrets in whole texts, and how widely each value is held: DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.llm.common import spread_join, stored

#: The words before an assigned value.
WORDS = ("password", "passwd", "secret", "token", "api_?key")
#: The patterns of the base kinds. Matches of the last two that are too short never hide longer ones, so their length is part of the pattern.
ASSIGN = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in WORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
#: Kinds in their order; `owned` spans are added by the corpus.
KINDS = ("assign", "access", "hex", "owned")
#: Unnamed long words that may be credentials, and what they must hold and not hold.
WORD, HOLDS, LACKS = "[A-Za-z0-9_+-]{16,}", ("[0-9]", "[A-Za-z]"), f"{ACCESS}|{HEX}"
#: Lengths that are added up in one go.
STRIDE = 128

_NO_SPANS = "array<struct<start:long,kind:int,end:long,value:string>>"


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda s, x: s + x)


def _running(numbers: Column) -> Column:
    """The sum up to and with each number of an array of longs. Sums within strides, then over strides: near linear, where one fold would copy its whole result for each number."""

    def folded(part: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<long>").alias("out"))
        more = lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["out"], F.array(a["s"] + x)).alias("out"))
        return F.aggregate(part, start, more, lambda a: a["out"])

    strides = F.transform(F.sequence(F.lit(1), F.greatest(F.size(numbers), F.lit(1)), F.lit(STRIDE)), lambda at: folded(F.slice(numbers, at, STRIDE)))
    before = F.concat(F.array(F.lit(0).cast("long")), folded(F.transform(strides, lambda s: F.coalesce(F.element_at(s, -1), F.lit(0).cast("long")))))
    return F.flatten(F.zip_with(strides, F.slice(before, 1, F.size(strides)), lambda s, b: F.transform(s, lambda x: x + b)))


def matches(text: Column, pattern: str, kind: int, needs: tuple[str, ...] = ("",)) -> Column:
    """(start, kind, end, value) of every leftmost match, in code points, the value being the match.

    What lies between matches and the matches themselves take turns, so their lengths add up to the places. needs: plain
    strings of which every match holds one; a text without them is not searched.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    long = lambda x: F.char_length(x).cast("long")
    ends = _running(F.zip_with(F.slice(between, 1, F.size(found)), found, lambda p, m: long(p) + long(m)))
    spans = F.zip_with(found, ends, lambda m, e: F.struct((e - long(m)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), m.alias("value")))
    there = reduce(or_, [F.contains(text, F.lit(x)) for x in needs])
    return F.when(there & F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.array().cast(_NO_SPANS))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_spans(docs: DataFrame, repository: str, owner: str, distinct: int = 8) -> DataFrame:
    """(doc_id, repository, owner, base, words) of every row: base and candidate spans (start, kind, end, value), values as digests.

    base: assignments of 8 and more characters, access ids, long hexadecimal numbers. words: long words with letters, digits and
    `distinct` different characters in what the assignments leave, unless they hold one of the other two kinds.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.col(repository).alias("_repository"), F.col(owner).alias("_owner"), text.alias("_text"))
    rows = rows.withColumn("_assigned", matches(F.col("_text"), ASSIGN, 0, (":", "="))).withColumn("_access", matches(F.col("_text"), ACCESS, 1, ("AKIA",))).withColumn("_hex", matches(F.col("_text"), HEX, 2))
    value = lambda s: F.regexp_extract(s["value"], ASSIGN, 2)
    digest = lambda s, v: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.unhex(F.md5(v)).alias("value"))
    named = F.transform(F.filter("_assigned", lambda s: F.char_length(value(s)) >= 8), lambda s: digest(s, value(s)))
    plain = F.transform(F.concat("_access", "_hex"), lambda s: digest(s, s["value"]))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("_assigned", lambda s: s["end"]))
    pieces = F.zip_with(F.split("_text", ASSIGN, -1), starts, lambda p, at: F.transform(matches(p, WORD, 3), lambda s: F.struct((s["start"] + at).alias("start"), s["kind"].alias("kind"), (s["end"] + at).alias("end"), s["value"].alias("value"))))

    def likely(s: Column) -> Column:
        v = s["value"]
        return F.regexp_like(v, F.lit(HOLDS[0])) & F.regexp_like(v, F.lit(HOLDS[1])) & ~F.regexp_like(v, F.lit(LACKS)) & (F.size(F.array_distinct(F.split(v, ""))) >= distinct)

    words = F.when(F.regexp_like("_text", F.lit(WORD)), F.transform(F.filter(F.flatten(pieces), likely), lambda s: digest(s, s["value"])))
    none = F.array().cast("array<struct<start:long,kind:int,end:long,value:binary>>")
    return rows.select("doc_id", "_repository", "_owner", F.concat(named, plain).alias("base"), F.coalesce(words, none).alias("words"))


def value_owners(spans: DataFrame) -> DataFrame:
    """(value, repositories, owners, held, spans) of every value in find_spans() rows: in how many different repositories, owners and rows, and how often.

    Rows are counted by (value, owner, repository) before values meet; null is an owner and a repository like others.
    """
    each = spans.select("_repository", "_owner", F.explode(F.concat(F.transform("base", lambda s: s["value"]), F.transform("words", lambda s: s["value"]))).alias("value"))
    counts = each.groupBy("value", F.struct("_owner").alias("o"), F.struct("_repository").alias("r")).agg(F.count("*").alias("spans"))
    return counts.groupBy("value").agg(F.count_distinct("r").alias("repositories"), F.count_distinct("o").alias("owners"), F.sum("spans").alias("spans"))


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", few: int = 1, many: int = 3) -> DataFrame:
    """One row per row of docs (doc_id, text, repository and owner): base counts and digest, all spans, and who holds the values.

    n_assign, n_access, n_hex; base_sha256 of the base spans `kind:start:end`; spans: base ones and, of kind owned, long words that no
    base pattern names but that `few` owners at most hold in the whole corpus. Of base and added spans together, n_live counts values
    with at most `few` owners, n_copied those with `many` and more (examples that are copied widely), n_shared what lies between; repositories
    is the highest number of repositories that hold one of the row's values.

    Values are counted by a digest, after counts per (value, owner, repository). Rows with the same values share one
    verdict, which is joined back by those values, hot ones without a shuffle; so repeated rows and null or repeated ids need no care.
    A null text is empty; without spans the digest is that of the empty text, and counts are 0. Null owners are one owner. Other columns,
    whatever their names, are not read. An empty table gives no rows.
    """
    rows = find_spans(docs, repository, owner)
    values = F.array_distinct(F.transform(F.concat("base", "words"), lambda s: s["value"]))
    rows = stored(rows.withColumn("_values", values).withColumn("_key", F.when(F.size("_values") > 0, F.md5(F.array_join(F.transform("_values", F.hex), ",")))), "spans")
    holding = rows.filter("_key is not null")
    owners = value_owners(holding)
    lists = holding.groupBy("_key").agg(F.count("*").alias("n"), F.min("_values").alias("_values"))  # of equal lists
    lists = stored(lists, "values")
    pairs = lists.select("_key", F.explode("_values").alias("value"))
    sizes = pairs.groupBy("value").agg(F.count("*").alias("n"))
    verdicts = spread_join(pairs, sizes.join(owners, "value"), ["value"], pairs.count())
    known = verdicts.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct(F.hex("value").alias("value"), F.struct("owners", "repositories").alias("of")))).alias("_of"))
    joined = spread_join(holding, lists.select("_key", "n").join(known, "_key"), ["_key"], holding.count())
    nobody = rows.filter("_key is null").withColumn("_of", F.lit(None).cast(joined.schema["_of"].dataType))
    every = joined.select(*nobody.columns).unionByName(nobody)
    of = lambda s: F.col("_of")[F.hex(s["value"])]
    every = every.withColumn("_added", F.filter("words", lambda s: of(s)["owners"] <= few))
    every = every.withColumn("_all", F.concat("base", "_added")).withColumn("_held", F.transform("_all", lambda s: of(s)["owners"]))
    kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    held = lambda test: F.size(F.filter("_held", test)).cast("long")
    return every.select(
        "doc_id", kind(0).alias("n_assign"), kind(1).alias("n_access"), kind(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("_all")).alias("spans"),
        F.size("_added").cast("long").alias("n_owned"), held(lambda n: n <= few).alias("n_live"), held(lambda n: (n > few) & (n < many)).alias("n_shared"), held(lambda n: n >= many).alias("n_copied"),
        F.coalesce(F.array_max(F.transform("_all", lambda s: of(s)["repositories"])), F.lit(0)).cast("long").alias("repositories"),
    )
