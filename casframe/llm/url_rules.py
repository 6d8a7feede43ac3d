"""URL filters: a rule list, and association rules mined from labelled URLs.

A URL's tokens are its scheme, host labels, path words and query names.
FP-growth finds the token combinations that are frequent among the bad labelled URLs:
each token's prefixes, with their numbers of URLs and of bad ones, go to one task, which
grows FP-trees from them.  A combination becomes a rule if the lower end of its
confidence's interval reaches the least confidence, and the rate of bad URLs by a
margin, so that labels without any relation to URLs give no rules.  A rule blocks a URL,
unless one of the list decides.  Mined rules are matched by an inverted index: each
stands under its rarest token.

All tokens of all labelled URLs are mined.  What is not grown is only what cannot be a rule,
as a part of its tokens implies bad as surely: tokens that stand in just the same URLs
are one class, of which a combination has one member, and a token that all URLs of a
combination hold does not extend it, nor does any where all of these are bad already.  Beyond that the
work is in proportion to the number of frequent combinations, which can double with
each token that many long URLs hold independently of each other.

Defined cases: a null URL, or one without `://`, has an empty host and path and no tokens
but that, and is allowed; repeated rows are judged each; without labels nothing is
mined; an empty table gives no rows; of a very long URL all tokens are mined and matched;
other columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casframe.llm.common import cut

#: Share of the bad labelled URLs that a mined rule holds for, and the confidence that it has at least.
MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.6
#: Labelled bad rows that a mined rule must hold for.
MIN_ROWS = 5
#: Standard deviations that the confidence's lower end lies below it, and how far that must pass the rate of bad URLs.
Z, MARGIN = 3.0, 0.1

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path) of the rule list.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, _AZ, _az), path


def listed(rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest rule of the list that fits host and path, as (n, rule, verdict), or null."""
    fits = None
    for verdict, host, path in rules:
        hit = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        one = F.when(hit, F.struct(F.lit(len(host + path)).alias("n"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict")))
        fits = [one] if fits is None else [*fits, one]
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def tokens() -> Column:
    """The distinct tokens of host, path and url; digits within path words are one class."""
    known = F.col("host") != ""
    labels = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("host:"), x))
    words = F.transform(F.regexp_extract_all(F.translate("path", _AZ, _az), F.lit(r"[^/.\-_]+"), F.lit(0)), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"\d+", "0")))
    names = F.transform(F.regexp_extract_all(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1)), lambda x: F.concat(F.lit("query:"), x))
    scheme = F.array(F.concat(F.lit("scheme:"), F.lower(F.regexp_extract("url", r"^([^:]*)://", 1))))
    return F.when(known, F.array_distinct(F.concat(scheme, labels, words, names))).otherwise(F.array(F.lit("host:")))


@dataclass(frozen=True)
class MinedRule:
    items: tuple[str, ...]
    confidence: float
    support: float

    def __str__(self) -> str:
        return " ".join(self.items)

    @property
    def classes(self) -> tuple[tuple[str, ...], ...]:
        return tuple((x,) for x in self.items)


@dataclass(frozen=True)
class Combination:
    """The rules that have one token of each class, whose tokens stand in just the same labelled URLs."""

    classes: tuple[tuple[str, ...], ...]
    confidence: float
    support: float

    def rules(self) -> Iterator[MinedRule]:
        return (MinedRule(tuple(sorted(items)), self.confidence, self.support) for items in product(*self.classes))


def lower_end(hits: float, n: float, z: float) -> float:
    """The lower end of Wilson's interval of a share."""
    if not z:
        return hits / n
    p, zz = hits / n, z * z
    return (p + zz / (2 * n) - z * math.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)


def index_of(itemsets: list[tuple]) -> dict[object, list[tuple[int, frozenset]]]:
    """Each combination under the one of its tokens that stands in the fewest of them."""
    times = Counter(x for items in itemsets for x in items)
    index: dict[object, list[tuple[int, frozenset]]] = defaultdict(list)
    for i, items in enumerate(itemsets):
        index[min(items, key=lambda x: (times[x], x))].append((i, frozenset(items)))
    return dict(index)


def held(index: dict[object, list[tuple[int, frozenset]]], items: Iterable) -> list[int]:
    """Numbers of the combinations that a URL's tokens hold."""
    own = set(items)
    return [i for x in own for i, need in index.get(x, ()) if need <= own]


class _Node:
    __slots__ = ("item", "up", "below", "n", "bad")

    def __init__(self, item: int, up: _Node | None) -> None:
        self.item, self.up, self.below, self.n, self.bad = item, up, {}, 0, 0

    def path(self) -> list[int]:
        out, node = [], self.up
        while node is not None:
            out.append(node.item)
            node = node.up
        return out[::-1]


def fp_tree(base: Iterable[tuple[list[int], int, int]]) -> dict[int, list[_Node]]:
    """The nodes of each item in the tree of paths (items, commonest first; rows; bad rows)."""
    top: dict[int, _Node] = {}
    nodes: dict[int, list[_Node]] = defaultdict(list)
    for path, n, bad in base:
        below, up = top, None
        for x in path:
            if (node := below.get(x)) is None:
                node = below[x] = _Node(x, up)
                nodes[x].append(node)
            node.n += n
            node.bad += bad
            below, up = node.below, node
    return nodes


def grown(items: tuple[int, ...], n: int, base: list[tuple[list[int], int, int]], least: int) -> Iterator[tuple[tuple[int, ...], int, int]]:
    """(combination, rows, bad rows) of those that extend items, which n rows hold, by items of base, their conditional pattern base.

    A combination has least bad rows.  Items that all n rows hold do not extend, and combinations all of whose rows are bad are not extended.
    """
    all_: Counter[int] = Counter()
    bad: Counter[int] = Counter()
    for path, rows, bad_rows in base:
        for x in path:
            all_[x] += rows
            bad[x] += bad_rows
    kept = {x for x in all_ if bad[x] >= least and all_[x] < n}
    for x, nodes in fp_tree(([x for x in path if x in kept], rows, bad_rows) for path, rows, bad_rows in base).items():
        yield (*items, x), all_[x], bad[x]
        if bad[x] < all_[x]:
            yield from grown((*items, x), all_[x], [(node.path(), node.n, node.bad) for node in nodes if node.up], least)


def combinations(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, z: float = 0.0, margin: float = 0.0) -> list[Combination]:
    """Rules tokens -> bad over (tokens, bad), without those that a part of their tokens implies as surely.

    min_support is a share of all labelled rows.  The driver gets the frequent tokens, of which rows of t tokens
    have t / min_support at most, and the combinations that are sure enough.
    """
    labelled = labelled.select(F.array_sort(F.array_distinct("tokens")).alias("tokens"), F.coalesce("bad", F.lit(False)).alias("bad"))
    labelled = cut(labelled.groupBy("tokens").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")))
    n, n_bad = labelled.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if not n_bad:
        return []
    need = max(min_confidence, n_bad / n + margin) if margin else min_confidence
    least = max(math.ceil(min_support * n), MIN_ROWS)
    if z:  # m rows, all of them bad, reach m / (m + z * z)
        least = max(least, math.floor(need * z * z / (1 - need))) if need < 1 else n + 1
    sure = lambda bad, rows: lower_end(bad, rows, z) >= need

    rows = labelled.select("n", "bad", F.xxhash64("tokens").alias("x"), F.xxhash64(F.lit(1), "tokens").alias("y"), F.explode("tokens").alias("token"))
    often = rows.groupBy("token").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where(F.col("bad") >= least)
    alike: dict[tuple[int, ...], list[str]] = defaultdict(list)  # by a 128-bit hash of the rows that hold the token
    for r in often.collect():
        alike[r.n, r.bad, r.x, r.y].append(r.token)
    found = sorted(((rows, bad, tuple(sorted(tokens))) for (rows, bad, _, _), tokens in alike.items()), key=lambda c: (-c[0], c[2]))
    classes = [c[2] for c in found]
    rules = [((i,), rows, bad) for i, (rows, bad, _) in enumerate(found) if sure(bad, rows)]
    known = {tokens[0]: i for i, (rows, bad, tokens) in enumerate(found) if bad < rows < n}  # what may be a part of more
    if len(known) > 1:
        spark = labelled.sparkSession
        shared = spark.sparkContext.broadcast(known)
        held_by = spark.sparkContext.broadcast([rows for rows, _, _ in found])

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                paths = [sorted(shared.value[x] for x in tokens or () if x in shared.value) for tokens in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.list_(pa.int32())), b.column(1), b.column(2)], names=["path", "n", "bad"])

        def grow(group: pa.Table) -> pa.Table:
            item = group["item"][0].as_py()
            base = list(zip(*(group[c].to_pylist() for c in ("path", "n", "bad")), strict=True))
            out = [x for x in grown((item,), held_by.value[item], base, least) if sure(x[2], x[1])]
            return pa.table({"items": pa.array([x[0] for x in out], pa.list_(pa.int32())), "n": pa.array([x[1] for x in out], pa.int64()), "bad": pa.array([x[2] for x in out], pa.int64())})

        sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        paths = labelled.select("tokens", "n", "bad").mapInArrow(numbered, "path array<int>, n long, bad long").where("size(path) > 1").groupBy("path").agg(*sums)
        bases = paths.select("n", "bad", "path", F.posexplode("path").alias("pos", "item")).where("pos > 0").select("item", F.expr("slice(path, 1, pos)").alias("path"), "n", "bad").groupBy("item", "path").agg(*sums)
        rules += [(tuple(r["items"]), r["n"], r["bad"]) for r in bases.groupBy("item").applyInArrow(grow, "items array<int>, n long, bad long").collect()]

    index = index_of([items for items, _, _ in rules])
    confidence = [bad / rows for _, rows, bad in rules]
    out = []
    for i, (items, _, bad) in enumerate(rules):
        if all(confidence[k] < confidence[i] for k in held(index, items) if k != i):
            out.append(Combination(tuple(classes[x] for x in items), confidence[i], bad / n))
    return out


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, z: float = 0.0, margin: float = 0.0) -> list[MinedRule]:
    """The rules of all combinations, each by itself, the shortest first."""
    found = (r for c in combinations(labelled, min_support, min_confidence, z, margin) for r in c.rules())
    return sorted(found, key=lambda r: (len(r.items), r.items))


def matcher(rules: list[MinedRule] | list[Combination]):
    """tokens -> the most confident rule all of whose items are among them, or None."""
    number = {c: i for i, c in enumerate(dict.fromkeys(c for r in rules for c in r.classes))}
    class_of = {x: i for c, i in number.items() for x in c}
    needed = [tuple(number[c] for c in r.classes) for r in rules]
    index = index_of(needed)

    def match(items: list[str]) -> MinedRule | None:
        own: dict[int, str] = {}
        for x in items:
            if (i := class_of.get(x)) is not None:
                own[i] = max(own.get(i, x), x)
        found = (MinedRule(tuple(sorted(own[c] for c in needed[i])), rules[i].confidence, rules[i].support) for i in held(index, own))
        return max(found, key=lambda r: (r.confidence, r.support, r.items), default=None)

    return match


def labels_by_number(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (doc_id, quality, toxic) of pages (doc_id = page_id) whose path names a document by its number, as in `/en/17.html`."""
    named = pages.select(F.col("page_id").alias("__page"), F.expr(r"try_cast(regexp_extract(url, '://[^/?#]*/[A-Za-z]+/([0-9]+)', 1) AS bigint)").alias("__number"))
    own = labels.select(F.col("doc_id").alias("__doc"), "quality", "toxic")
    return own.join(named, F.col("__doc") == F.col("__number")).select(F.col("__page").alias("doc_id"), "quality", "toxic")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, mined_rule, confidence.

    labels gives quality and toxic for pages, by the page's id; bad is quality 0 or toxic 1.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path}).withColumn("tokens", tokens())
    bad = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    labelled = cut(rows.join(bad, rows.page_id == bad.doc_id).select("tokens", "bad"))
    share = labelled.agg(F.avg(F.col("bad").cast("double"))).first()[0] or 0.0
    mined = combinations(labelled, MIN_SUPPORT * share, z=Z, margin=MARGIN)
    shared = pages.sparkSession.sparkContext.broadcast(mined)
    rows = rows.withColumn("__list", listed(rules)).select("page_id", "host", "path", F.col("__list.rule").alias("rule"), F.col("__list.verdict").alias("listed"), "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher(shared.value)
        for b in batches:
            hits = [match(t) for t in b.column("tokens").to_pylist()]
            verdicts = [v or ("block" if h else "allow") for v, h in zip(b.column("listed").to_pylist(), hits, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array([h and str(h) for h in hits], pa.string()), pa.array([h and h.confidence for h in hits], pa.float64())],
                names=["page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence"],
            )

    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, mined_rule string, confidence double")
