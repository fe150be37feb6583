"""Substring dedup by repeated-phrase automata.

Every window of the asked length holds a phrase that its own words pick: the one of least hash. Packs of documents send the
words of these phrases to shards, which confirm word for word which of them recur in the corpus and send those back. Of what
it got each pack compiles Aho-Corasick automata, bounded in size, and streams all of its documents through them: their hits
are all that is known of where phrases stand. A window can recur only if the phrase that it picks does, so the windows
around hits are then counted over the corpus, by 128-bit hashes of all their words.

A recurring phrase that no window of a pack picks cannot make a window of that pack recur, so a pack needs the automata of
its own phrases only; streaming every pack through the phrases of the whole corpus would cost its square.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import drop, store, table
from .packs import ASKED, PACK, ask, batch, by_shard, in_order, pack, told, trim, unpack

WINDOW, PHRASE = 35, 8  # words
AUTOMATON = 100_000  # phrases of one automaton
_GAP = 0xE000  # symbol of words that no phrase of an automaton has
_BASES = tuple(np.uint64(b) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


class Words:
    """The words of a pack's documents: ids within the pack, hashes, and where documents end."""

    def __init__(self, data: bytes):
        self.texts, self.rows = unpack(data)
        ids: defaultdict[bytes, int] = defaultdict()
        ids.default_factory = ids.__len__  # a new word gets the next number
        numbers, sizes = [], []
        for text in self.texts:
            own = text.split()  # bytes split at the six ASCII blanks
            numbers.append(np.fromiter(map(ids.__getitem__, own), np.int64, len(own)))
            sizes.append(len(own))
        self.sizes = np.array(sizes, np.int64)
        self.numbers = ids
        self.ids = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids))
        self.hashes = hashes[self.ids]
        self.ends = np.cumsum(self.sizes)

    def rolled(self, size: int, base: np.uint64) -> np.ndarray:
        """Polynomial hash of every size words in a row."""
        n = len(self.hashes)
        if n < size:
            return np.empty(0, np.uint64)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        powers = np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])
        sums = np.r_[np.uint64(0), np.cumsum(self.hashes * np.cumprod(np.r_[np.uint64(1), np.full(n - 1, inverse, np.uint64)]))]
        h = (sums[size:] - sums[:-size]) * powers[: n - size + 1]
        return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) ^ h >> np.uint64(32)

    def starts(self, size: int) -> np.ndarray:
        """Where windows of size words start that stay within a document."""
        n = len(self.ids) - size + 1
        if n <= 0:
            return np.empty(0, np.int64)
        return np.flatnonzero(np.arange(n) + size <= np.repeat(self.ends, self.sizes)[:n])

    def picks(self, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows, place of the phrase that each picks (the first of least hash), and all phrase hashes."""
        h = self.rolled(phrase, _BASES[2])
        starts = self.starts(window)
        if not len(starts):
            return starts, starts, h
        span = window - phrase + 1
        low, at, step = h, np.arange(len(h)), 1
        while step < span:
            k = min(step, span - step)
            first, other = low[: len(low) - k], low[k:]
            better = other < first
            low, at = np.where(better, other, first), np.where(better, at[k:], at[: len(at) - k])
            step += k
        return starts, at[starts], h


def _sent(texts: list[bytes], twice: np.ndarray) -> bytes:
    """Phrases, with a bit each for whether the sender holds it twice. Words have no line breaks."""
    return len(texts).to_bytes(4, "little") + np.packbits(twice).tobytes() + zstandard.compress(b"\n".join(texts), 1)


def _received(data: bytes) -> tuple[list[bytes], np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    bits = 4 + -(-n // 8)
    return zstandard.decompress(data[bits:]).split(b"\n") if n else [], np.unpackbits(np.frombuffer(data[4:bits], np.uint8), count=n)


def picked_phrases(words: Words, window: int, phrase: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The distinct phrases that windows pick, in the order of their hashes: hash, words, and whether it stands at two places."""
    _, at, h = words.picks(window, phrase)
    if not len(at):
        return np.empty(0, np.uint64), [], np.empty(0, bool)
    places = np.unique(at)
    places = places[np.argsort(h[places], kind="stable")]
    spelt, keys = words.ids[places[:, None] + np.arange(phrase)], h[places]
    fresh = np.r_[True, (spelt[1:] != spelt[:-1]).any(1)]  # other words under one hash are another phrase, so nothing is taken for another's copy
    starts = np.flatnonzero(fresh)
    vocabulary = list(words.numbers)
    texts = [b" ".join([vocabulary[k] for k in row]) for row in spelt[starts].tolist()]
    return keys[starts], texts, np.diff(np.r_[starts, len(places)]) > 1


def _phrases(window: int, phrase: int, shards: int):
    """Asks for the phrases that the windows of a pack pick."""

    def run(batches):
        for b in batches:
            for number, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys, texts, twice = picked_phrases(Words(data), window, phrase)
                full, bounds = by_shard(keys, shards)
                yield batch(ASKED, full, np.full(len(full), number), [_sent(texts[lo:hi], twice[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:])])
                trim()

    return run


def _recurring_phrases(shard: int, asked: list[bytes]) -> list[bytes]:
    """Of what each pack asks for, the phrases that stand at two places of the corpus, compared word for word."""
    places: dict[bytes, int] = {}
    get = places.get
    for a in asked:
        for text, twice in zip(*_received(a)):
            places[text] = get(text, 0) + 1 + int(twice)
    out = []
    for a in asked:
        again = [text for text in _received(a)[0] if places[text] > 1]
        out.append(_sent(again, np.zeros(len(again), bool)))
    return out


def compiled(phrases: np.ndarray) -> tuple[ahocorasick.Automaton, np.ndarray]:
    """An automaton of the rows of phrases, and the code of each word number up to the largest, -1 for words of no phrase.

    A word is two symbols, from disjoint ranges, so that no node of the automaton has many edges to search through.
    """
    known = np.full(int(phrases.max()) + 1, -1, np.int64)
    vocabulary = np.unique(phrases)
    known[vocabulary] = np.arange(len(vocabulary))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_STRING)
    symbols, size = _symbols(known[phrases].ravel()), 2 * phrases.shape[1]
    for k in range(0, len(symbols), size):
        automaton.add_word(symbols[k : k + size], 1)
    automaton.make_automaton()
    return automaton, known


def _symbols(codes: np.ndarray) -> str:
    pair = np.stack([(codes >> 8) + 256, codes & 255], -1)
    pair[codes < 0] = _GAP
    return pair.astype("<u4").tobytes().decode("utf-32-le")


def located(words: Words, texts: list[bytes], phrase: int, most: int = AUTOMATON) -> np.ndarray:
    """Where any of the phrases starts in the documents of a pack, each document streamed through all automata."""
    found = np.zeros(len(words.ids), bool)
    spelt = np.array([[words.numbers[w] for w in text.split(b" ")] for text in texts], np.int64).reshape(-1, phrase)
    starts = np.r_[0, words.ends[:-1]] if len(words.ends) else words.ends
    for k in range(0, len(spelt), most):
        automaton, known = compiled(spelt[k : k + most])
        codes = np.full(len(words.ids), -1, np.int64)
        inside = words.ids < len(known)
        codes[inside] = known[words.ids[inside]]
        for lo, hi in zip(starts.tolist(), words.ends.tolist()):
            if hi - lo >= phrase:
                ends = [end for end, _ in automaton.iter(_symbols(codes[lo:hi]))]
                found[np.array(ends, np.int64) // 2 + (lo - phrase + 1)] = True
    return found


def _unpacked(parts: dict[int, bytes], keys: np.ndarray, shards: int) -> np.ndarray:
    """A bit for each of the sorted keys, from the answers of the shards."""
    out = np.zeros(len(keys), bool)
    full, bounds = by_shard(keys, shards)
    for k, a, b in zip(full.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        if k in parts:
            out[a:b] = np.unpackbits(np.frombuffer(parts[k], np.uint8), count=b - a).astype(bool)
    return out


def _window_keys(words: Words, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, check) of the windows at starts, sorted, how often each stands there, and which of them each window is."""
    a, b = (words.rolled(window, base)[starts] if len(starts) else np.empty(0, np.uint64) for base in _BASES[:2])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(fresh) - 1
    return np.stack([a[fresh], b[fresh]], 1), np.bincount(which, minlength=int(fresh.sum())), which


def _windows(window: int, phrase: int, shards: int):
    """Asks for the windows around located phrases. What goes to a shard from shards on comes back as it is: which windows of the pack these are."""

    def run(batches):
        for b in batches:
            for number, data, answers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = Words(data)
                starts, at, _ = words.picks(window, phrase)
                near = located(words, [t for a in in_order(answers).values() for t in _received(a)[0]], phrase)[at]
                keys, counts, _ = _window_keys(words, starts[near], window)
                full, bounds = by_shard(keys[:, 0], shards)
                blobs = [keys[lo:hi].tobytes() + np.packbits(counts[lo:hi] > 1).tobytes() for lo, hi in zip(bounds[:-1], bounds[1:])]
                yield batch(ASKED, [shards + number % shards, *full], [number] * (len(full) + 1), [np.packbits(near).tobytes(), *blobs])
                trim()

    return run


def _recurring_windows(shards: int, shard: int, asked: list[bytes]) -> list[bytes]:
    """A bit for each window: whether it stands twice in the corpus. Each pack's part is 16 bytes a window, then a bit a window."""
    if shard >= shards:
        return asked
    sizes = [len(a) * 8 // 129 for a in asked]
    keys = np.frombuffer(b"".join(a[: 16 * n] for a, n in zip(asked, sizes)), np.uint64).reshape(-1, 2)
    twice = np.concatenate([np.unpackbits(np.frombuffer(a[16 * n :], np.uint8), count=n) for a, n in zip(asked, sizes)])
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    own = keys[order]
    group = np.cumsum(np.r_[True, (own[1:] != own[:-1]).any(1)][: len(own)]) - 1
    again = np.empty(len(own), bool)
    again[order] = np.bincount(group, 1 + twice[order])[group] >= 2
    return [np.packbits(x).tobytes() for x in np.split(again, np.cumsum(sizes)[:-1])]


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _kept(text: bytes, gone: np.ndarray, layout: bool) -> str:
    """text without the words that are gone. layout keeps the blanks within what stays; else words are joined by a space."""
    if not layout:
        return b" ".join([w for w, g in zip(text.split(), gone.tolist()) if not g]).decode("utf-8", "surrogatepass")
    if not gone.any():
        return text.decode("utf-8", "surrogatepass")
    spans = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.r_[True, gone, True].astype(np.int8)))
    return b"\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in edges.reshape(-1, 2).tolist()).decode("utf-8", "surrogatepass")


def _removal(window: int, phrase: int, shards: int, layout: bool):
    def run(batches):
        for b in batches:
            for number, data, answers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words, parts = Words(data), in_order(answers)
                starts = words.starts(window)
                near = np.unpackbits(np.frombuffer(parts.pop(shards + number % shards), np.uint8), count=len(starts)).astype(bool)
                keys, _, which = _window_keys(words, starts[near], window)
                again = _unpacked(parts, keys[:, 0], shards)
                hit = starts[near][again[which]]
                cover = np.zeros(len(words.ids) + 1, np.int64)
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + window, -1)
                gone = np.cumsum(cover)[:-1] > 0
                each = np.split(gone, words.ends[:-1]) if len(words.ends) else []
                kept = [_kept(t, g, layout) for t, g in zip(words.texts, each)]
                removed = [int(g.sum()) for g in each]
                own = words.rows.drop_columns("text").append_column("n_words", pa.array(words.sizes, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))
                yield from own.append_column("kept", pa.array(kept, pa.string())).combine_chunks().to_batches()
                trim()

    return run


def _removed(docs: DataFrame, window: int, phrase: int, layout: bool, size: int) -> DataFrame:
    """docs with n_words, n_removed and kept in place of text."""
    packs, shards = pack(docs, size)
    phrase = min(phrase, window)
    asked = packs.select("pack", "data").mapInArrow(_phrases(window, phrase, shards), ASKED)
    recurring, path = store(ask(asked, _recurring_phrases), "recurring-phrases")
    asked = told(packs, recurring).select("pack", "data", "answers").mapInArrow(_windows(window, phrase, shards), ASKED)
    recurring, _ = store(ask(asked, partial(_recurring_windows, shards)), "recurring-windows")
    drop(docs.sparkSession, path)
    joined = told(packs, recurring).select("pack", "data", "answers")
    fields = [f for f in docs.schema.fields if f.name != "text"]
    added = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())]
    return joined.mapInArrow(_removal(window, phrase, shards, layout), StructType(fields + added))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, phrase: int = PHRASE, layout: bool = False, size: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text) of every row of docs.

    A word is removed if it is in a window of consecutive words that starts anywhere else too, in its own document or
    another. All windows are judged on the input. Null, empty and blank texts have no words; texts shorter than a window
    keep all. Repeated rows are copies of each other, so a repeated text of a window or more loses all its words. A null
    doc_id is carried through; an empty table gives no rows; other columns of docs are left aside. With layout, a text
    that loses nothing stays as it is and blanks within what stays are kept; else what stays is joined by single spaces.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return _removed(docs, window, phrase, layout, size or PACK)


def without_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """The rows of docs, with all their columns, without the words that remove_repeats() removes.

    Layout is kept and n_chars, if there is one, follows the text. A row that loses all its words goes; one that had none stays.
    """
    done = docs.select([F.col(f"`{c}`").alias(f"c{k}" if c != "text" else "text") for k, c in enumerate(docs.columns)])  # whatever docs' columns are called
    done = _removed(done, window, phrase, True, PACK).where("n_removed < n_words OR n_words = 0")
    given = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept"))}
    columns = []
    for k, c in enumerate(docs.columns):
        kind = dict(docs.dtypes)[c]
        own = F.col("kept") if c == "text" else F.coalesce(given[c], F.col(f"c{k}")) if c in given else F.col(f"c{k}")
        columns.append(own.cast(kind).alias(c))
    return done.select(columns)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT r, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35),
windows AS (SELECT r, k, array_to_string(w[k : k + 34], ' ') AS t FROM starts JOIN d USING (r)),
twice AS (SELECT t FROM windows GROUP BY t HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(k, k + 35)) AS p FROM windows SEMI JOIN twice USING (t)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
