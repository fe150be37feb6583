"""Source divergence audit: how far the sources of a language differ in the terms they use, and by which terms.

A group (a language's source) gives each kept term of its language a whole-number share p; a pair of groups differs by the
sum of |p_g - p_h| over all of them. A term that a group lacks has the group's base share b, so a pair's sum is
V |b_g - b_h| and, for each term that either has, what it adds to |b_g - b_h|. Terms that many groups have are laid out in
dense tiles, a block of groups against another over a chunk of terms. Of terms that few groups have, what one side alone
adds depends only on its share and the other's base, so a group's counts of shares say it for all partners at once; and
each pair of groups in such a term's posting adds a correction for having it both. All of it is in whole numbers, so the
parts add up exactly in any order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped_after, store, table

LEAST_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
HELD = 200_000  # terms that a task counts before it hands them on
SLICE = 1 << 20  # bytes of a text that are split into words at once
HEAVY = 4  # a term is heavy if one in so many of its language's groups has it
BLOCK = 128  # groups of a block
ROWS = 500_000  # rows of a tile, or of a bucket of postings, that are aimed at
PAIRS = 2_000_000  # corrections that are gathered before they are summed by pair

#: What each byte is in a term: A-Z in lower case, bytes that terms lack as a space. Letters beyond ASCII have no byte under 128.
IN_TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, a slice at a time."""
    clean, at = text.translate(IN_TERMS), 0
    while at < len(clean):
        end = clean.find(b" ", at + SLICE)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, count, docs of a task's documents, handed on whenever HELD terms are gathered; a row without a term for each group."""
    counts: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    held = 0

    def out() -> pa.RecordBatch:
        rows = [(*g, t, n, docs[g][t]) for g, own in counts.items() for t, n in own.items()] + [(*g, None, 0, 0) for g in counts]
        lang, source, term, n, d = zip(*rows) if rows else [()] * 5
        texts = [pa.array(x, pa.binary()).view(pa.string()) for x in (lang, source, term)]
        return pa.RecordBatch.from_arrays([*texts, pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["lang", "source", "term", "count", "docs"])

    for b in batches:
        lang, source, text = (pc.cast(c, pa.binary()) for c in b.columns)
        for k in range(b.num_rows):
            g = (lang[k].as_py() or b"", source[k].as_py() or b"")
            own, in_docs, seen = counts.setdefault(g, Counter()), docs.setdefault(g, Counter()), set()
            held -= len(own)
            for words in terms(text[k].as_py() or b""):
                own.update(words)
                seen.update(words)
            in_docs.update(seen)
            held += len(own)
            if held >= HELD:
                yield out()
                counts.clear()
                docs.clear()
                held = 0
    if counts:
        yield out()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, count, docs: how often a group has a term, and in how many documents. A null term for each group stands for the group itself."""
    rows = docs.select(*[F.col(c).cast("string") for c in (lang, source, text)])
    parts = rows.mapInArrow(_counted, "lang string, source string, term string, count bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column | int, total: Column, kept: Column, smoothing: int, scale: int) -> Column:
    """1 + floor(scale * (count + smoothing) / (total + smoothing * kept)); 0 where no term is kept."""
    whole = lambda c: c.cast("decimal(20,0)")
    count = F.lit(count) if isinstance(count, int) else count
    above, below = F.lit(scale).cast("decimal(12,0)") * whole(count + smoothing), F.nullif(whole(total + smoothing * kept), F.lit(0).cast("decimal(20,0)"))
    return F.coalesce(F.call_function("div", above, below) + 1, F.lit(0).cast("bigint"))


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the exact sums of their values."""
    if not len(key):
        return key, value
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(value, first)


def _pairs(lang, names: list[str], g: np.ndarray, h: np.ndarray, value: np.ndarray) -> pa.Table:
    """Rows of pairs of groups, the one whose name comes first as source."""
    place = np.empty(len(names), np.int64)
    place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))  # strings compare as their UTF-8 does
    swap = place[g] > place[h]
    g, h = np.where(swap, h, g), np.where(swap, g, h)
    all_names = pa.array(names, pa.string())
    return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "source": all_names.take(pa.array(g)), "item": all_names.take(pa.array(h)), "value": pa.array(value, pa.int64())})


def one_sided(p: np.ndarray, n: np.ndarray, own: int, bases: np.ndarray) -> np.ndarray:
    """For each base, the sum over shares p, each of n terms, of |p - base| - |own - base|."""
    order = np.argsort(p)
    p, n = p[order], n[order]
    at = np.searchsorted(p, bases, "right")
    number, total = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * p)]
    return total[-1] - 2 * total[at] + bases * (2 * number[at] - number[-1]) - number[-1] * np.abs(own - bases)


def _tile(key: tuple, rows: pa.Table, groups: pa.Table) -> pa.Table:
    """A block of groups against another (or itself): dense over heavy terms (rows with a term), and by counts of shares for light ones.

    The first chunk also has V |b_g - b_h|, and so a row for every pair of its blocks.
    """
    lang, lo, hi, chunk = (k.as_py() for k in key)
    names, base = groups.column("source").to_pylist(), np.asarray(groups.column("base").combine_chunks())
    block = np.asarray(groups.column("block").combine_chunks())
    out = np.zeros((len(base), len(base)), np.int64)
    if rows.num_rows:
        group = np.asarray(pc.index_in(rows.column("source"), value_set=groups.column("source").combine_chunks()).combine_chunks())
        p, n = (np.asarray(rows.column(c).combine_chunks()) for c in ("p", "n"))
        heavy = np.asarray(pc.is_valid(rows.column("term")).combine_chunks())
        if heavy.any():
            codes = np.asarray(rows.column("term").combine_chunks().dictionary_encode().indices.fill_null(0))[heavy]
            dense = np.tile(base, (codes.max() + 1, 1))
            dense[codes, group[heavy]] = p[heavy]
            for g in range(len(base)):
                out[g] = np.abs(dense - dense[:, g : g + 1]).sum(axis=0) - len(dense) * np.abs(base - base[g])
        light = ~heavy
        for g in np.unique(group[light]).tolist():
            mine = light & (group == g)
            more = one_sided(p[mine], n[mine], int(base[g]), base)
            out[g] += more
            out[:, g] += more
    if chunk == 0:
        out += int(groups.column("kept")[0].as_py()) * np.abs(base[:, None] - base[None, :])
    wanted = np.triu(np.ones(out.shape, bool), 1) if lo == hi else (block == lo)[:, None] & (block == hi)[None, :]
    g, h = np.nonzero(wanted & ((out != 0) | (chunk == 0)))
    return _pairs(lang, names, g, h, out[g, h])


def _corrections(key: tuple, rows: pa.Table) -> pa.Table:
    """What pairs of groups that both have a light term add, beyond what each side adds by itself."""
    lang = key[0].as_py()
    terms, sources = (rows.column(c).combine_chunks().dictionary_encode() for c in ("term", "source"))
    names, size = sources.dictionary.to_pylist(), len(sources.dictionary)
    order = np.argsort(np.asarray(terms.indices), kind="stable")
    term, group, p, base = (np.asarray(x)[order] for x in (terms.indices, sources.indices, rows.column("p").combine_chunks(), rows.column("base").combine_chunks()))
    group = group.astype(np.int64)
    keys, values, gathered, lag = [], [], 0, 1
    left = np.flatnonzero(term[1:] == term[:-1])
    while len(left):
        right = left + lag
        both = np.abs(p[left] - p[right]) - np.abs(p[left] - base[right]) - np.abs(p[right] - base[left]) + np.abs(base[left] - base[right])
        keys.append(np.minimum(group[left], group[right]) * size + np.maximum(group[left], group[right]))
        values.append(both)
        gathered += len(left)
        if gathered > PAIRS:
            summed = _summed(np.concatenate(keys), np.concatenate(values))
            keys, values, gathered = [summed[0]], [summed[1]], 0
        lag += 1
        left = left[left + lag < len(term)]
        left = left[term[left] == term[left + lag]]
    key, value = _summed(np.concatenate(keys), np.concatenate(values)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return _pairs(lang, names, key // max(1, size), key % max(1, size), value)


PAIR = "lang string, source string, item string, value bigint"


def pair_values(rated: DataFrame, groups: DataFrame, heavy: int = HEAVY, block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    """lang, source, item, value: the difference of every two groups of a language, source before item.

    rated: lang, source, term, p, base, in_groups, sources. groups: lang, source, base, kept, sources.
    """
    is_heavy = F.col("in_groups") * heavy > F.col("sources")
    light = rated.where(~is_heavy)
    shares = light.groupBy("lang", "source", "p").agg(F.count("*").alias("n")).select("lang", "source", F.lit(None).cast("string").alias("term"), "p", "n")
    cells, _ = store(rated.where(is_heavy).select("lang", "source", "term", "p", F.lit(1).cast("bigint").alias("n")).unionByName(shares), "cells")
    sizes = groups.groupBy("lang").agg(F.ceil(F.first("sources") / block).cast("int").alias("blocks"))
    sizes = sizes.join(cells.groupBy("lang").agg(F.count("*").alias("cells")), "lang", "left")
    sizes = sizes.select("lang", "blocks", F.greatest(F.lit(1), F.ceil(F.coalesce("cells", F.lit(0)) / (rows * F.col("blocks")))).cast("int").alias("chunks"))
    sizes, _ = store(sizes, "tiles")  # a row a language
    own = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    unit = ["lang", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "chunk"]
    placed = cells.join(sizes, "lang").withColumn("block", own).withColumn("chunk", F.pmod(F.xxhash64("term", F.when(F.col("term").isNull(), F.col("p"))), F.col("chunks")).cast("int"))
    placed = placed.withColumn("other", others).select(*unit, "source", "term", "p", "n")
    members = groups.join(sizes, "lang").withColumn("block", own).withColumn("other", others).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    members = members.select(*unit, "source", "block", "base", "kept")
    keys = ["lang", "lo", "hi", "chunk"]
    dense = placed.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(_tile, PAIR)
    shared = light.where("in_groups > 1")
    buckets = shared.groupBy("lang").agg(F.ceil(F.count("*") / rows).cast("int").alias("buckets"))
    shared = shared.join(buckets, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), "term", "source", "p", "base")
    sparse = shared.groupBy("lang", "bucket").applyInArrow(_corrections, PAIR)
    return dense.unionByName(sparse).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, smoothing: int = SMOOTHING, scale: int = SCALE, top: int = TOP, heavy: int = HEAVY, block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    """lang, source, part, item, value, rank of every group, a source of a language.

    Null texts, languages and sources count as empty ones. A language keeps the terms that least_docs of its documents
    have. Part pair: every other source of the language, by how far the two groups' shares of all kept terms differ; 0
    where none is kept. Part term: the top terms that the group has and uses more than its language, by how much. Ties go
    by the item's UTF-8. A language of one source has no pairs, a group without kept terms no terms, an empty table gives
    none; repeated rows each count, and texts, terms and numbers of sources may be of any length.
    """
    with dropped_after(docs.sparkSession, keep := []):
        counted, _ = store(term_counts(docs, text, lang, source), "term-counts")
        found = counted.where("term IS NOT NULL")
        kept = found.groupBy("lang", "term").agg(F.sum("docs").alias("_docs"), F.sum("count").alias("in_lang"), F.count("*").alias("in_groups")).where(F.col("_docs") >= least_docs).drop("_docs")
        kept, _ = store(kept, "kept-terms")
        postings, _ = store(found.select("lang", "source", "term", "count").join(kept, ["lang", "term"]), "postings")

        sources = counted.where("term IS NULL").select("lang", "source")
        langs = sources.groupBy("lang").agg(F.count("*").alias("sources")).join(kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("in_lang").alias("lang_total")), "lang", "left").na.fill(0)
        totals = postings.groupBy("lang", "source").agg(F.sum("count").alias("total"))
        groups = sources.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(langs, "lang")
        groups, _ = store(groups.withColumn("base", share(0, F.col("total"), F.col("kept"), smoothing, scale)), "groups")
        p, q = (share(F.col(c), F.col(n), F.col("kept"), smoothing, scale) for c, n in (("count", "total"), ("in_lang", "lang_total")))
        rated, _ = store(postings.join(groups, ["lang", "source"]).select("lang", "source", "term", "in_groups", "sources", "base", p.alias("p"), q.alias("q")), "rated-terms")

        pairs = pair_values(rated, groups, heavy, block, rows)
        sides = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("s")
        pairs = pairs.select("lang", sides, "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
        used = rated.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (pairs, used)]
        out, path = store(ranked[0].unionByName(ranked[1].where(F.col("rank") <= top)), "divergence")
        keep.append(path)
    return out


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
w AS MATERIALIZED (SELECT r, lang, source, term, count(*) AS c FROM (SELECT r, lang, source, unnest(t) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(c) AS in_lang FROM w GROUP BY lang, term HAVING count(*) >= 30),
langs AS MATERIALIZED (SELECT lang, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang FROM d) LEFT JOIN (SELECT lang, count(*) AS v, sum(in_lang) AS n FROM kept GROUP BY lang) USING (lang)),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
counts AS MATERIALIZED (SELECT g.lang, g.source, k.term, k.in_lang, coalesce(c, 0) AS c FROM groups g JOIN kept k USING (lang)
  LEFT JOIN (SELECT lang, source, term, sum(c) AS c FROM w GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
totals AS MATERIALIZED (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
p AS MATERIALIZED (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 5)) // (t.n + 5 * v) AS p, 1 + (1000000000::HUGEINT * (in_lang + 5)) // (langs.n + 5 * v) AS q
  FROM counts JOIN totals t USING (lang, source) JOIN langs USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT, (row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term))::INTEGER AS rank FROM p WHERE c > 0 AND p > q QUALIFY rank <= 50
"""
