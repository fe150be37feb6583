"""Language ID by cross-parsing entropy.

Each language has a suffix automaton of a sample of its labelled text. A document is parsed by it from left to right: a
phrase is the longest match of what comes next anywhere in that text, or one symbol that the text lacks. The more alike
two texts are, the fewer phrases; a language's phrases are normalised by what it takes to name one, so many bits as
choosing a place in its text needs, per symbol of the document. The language of least bits wins.

Automata are packed into arrays so that thousands of lanes, stretches of documents, step through one together: a state is
an offset to which a symbol's code is added, and the place found there belongs to the state if it names it.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped_after, fold, store, table

SYMBOLS, PIECE, DRAWN = 65_536, 512, 8  # symbols of an automaton's text; characters of a piece of it; times SYMBOLS that are drawn to choose from
LITERALS = 1_024  # single symbols that a phrase can name beside the places of the text
AT_ONCE = 32  # languages whose automata are sent at once, some 2 MB each
LANE, HELD = 1_024, 2_000_000  # symbols of a lane; characters that are parsed at once, unless one document has more
EVIDENCE = 32  # symbols of a document that its score believes in at most
SPACE = 0x20
UNDETERMINED = "und"


@cache
def folding() -> tuple[np.ndarray, np.ndarray]:
    """For each code point the symbol that it counts as, lower-case letters and marks as themselves and all others as a space; and whether it is a letter."""
    symbol, letter = np.full(0x110000, SPACE, np.int32), np.zeros(0x110000, bool)
    for cp in range(0x110000):
        c = chr(cp)
        letter[cp] = c.isalpha()
        if letter[cp] or unicodedata.category(c)[0] == "M":
            symbol[cp] = ord(c.lower()[0])
    return symbol, letter


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of texts end to end, where each text starts (and the last ends), and which of them have a letter. A text starts with a space, and spaces do not repeat."""
    symbol, letter = folding()
    points = np.frombuffer("".join(f" {t}" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.r_[0, np.cumsum([len(t) + 1 for t in texts])].astype(np.int64)
    out = symbol[points]
    blank = out == SPACE
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[starts[:-1]] = True
    place = np.r_[0, np.cumsum(keep)]
    letters = np.r_[0, np.cumsum(letter[points])]
    return out[keep], place[starts], letters[starts[1:]] > letters[starts[:-1]]


def suffix_automaton(text: Iterable[int]) -> list[dict[int, int]]:
    """The steps (symbol: next state) of each state of the suffix automaton of text. State 0 is the start: what can be read from it is what text holds."""
    steps, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new, at = len(steps), last
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        while at >= 0 and c not in steps[at]:
            steps[at][c] = new
            at = link[at]
        if at >= 0:
            old = steps[at][c]
            if length[old] > length[at] + 1:  # old also stands for longer texts, which are not suffixes here
                split = len(steps)
                steps.append(dict(steps[old]))
                length.append(length[at] + 1)
                link.append(link[old])
                link[old] = split
                while at >= 0 and steps[at].get(c) == old:
                    steps[at][c] = split
                    at = link[at]
                old = split
            link[new] = old
        last = new
    return steps


class Automaton:
    """A packed suffix automaton of pieces of text, across whose ends nothing matches.

    A state is an offset: from state s, the symbol of code c leads to after[s + c] if owner[s + c] is s, and nowhere
    otherwise. From the state none nothing leads on, so each phrase starts with a miss there, and first[c] begins it. Code 0
    is of symbols that the pieces lack.
    """

    def __init__(self, alphabet: np.ndarray, owner: np.ndarray, after: np.ndarray, first: np.ndarray, size: int):
        self.alphabet, self.owner, self.after, self.first, self.size = alphabet, owner, after, first, size
        self.none = len(owner) - len(first)
        self.codes = np.zeros(0x110000, np.uint16 if len(first) < 1 << 16 else np.int32)
        self.codes[alphabet] = np.arange(1, len(alphabet) + 1)

    @staticmethod
    def of(pieces: list[np.ndarray]) -> Automaton:
        seen = Counter()
        for p in pieces:
            seen.update(p.tolist())
        alphabet = sorted(seen, key=lambda c: (-seen[c], c))
        code = {c: k for k, c in enumerate(alphabet, 1)}
        steps = suffix_automaton(c for p in pieces for c in (*map(code.__getitem__, p.tolist()), 0))
        for own in steps:
            own.pop(0, None)
        reached, todo = {0}, [0]
        while todo:
            new = [s for s in steps[todo.pop()].values() if s not in reached]
            reached.update(new)
            todo += new
        return Automaton._packed(steps, reached, alphabet, sum(map(len, pieces)))

    @staticmethod
    def _packed(steps: list[dict[int, int]], reached: set[int], alphabet: list[int], size: int) -> Automaton:
        """Each state at the first offset where the places of all its symbols are free; states of many symbols first."""
        width = len(alphabet) + 1
        taken, offsets, at = bytearray(width), set(), {}
        low = {}  # for each number of symbols, where the search for a free place goes on
        for s in sorted((s for s in reached if steps[s]), key=lambda s: -len(steps[s])):
            own = sorted(steps[s])
            least, tries = low.get(len(own), 0), 0
            place = max(least, own[0])
            while True:
                taken.extend(bytes(max(0, place + width + 1 - len(taken))))
                place = taken.index(0, place) if 0 in taken[place : place + 4 * width] else place + 4 * width
                taken.extend(bytes(max(0, place + width + 1 - len(taken))))
                offset = place - own[0]
                if offset not in offsets and not any(taken[offset + c] for c in own):
                    break
                place, tries = place + 1, tries + 1
            low[len(own)] = place if tries > 32 else least if tries else place  # where much is full the next search begins further on
            offsets.add(offset)
            at[s] = offset
            for c in own:
                taken[offset + c] = 1
        length = len(taken) + width  # the last width places stay free, for the state none
        owner, after = np.full(length, -1, np.int32), np.zeros(length, np.int32)
        none = length - width
        for s, offset in at.items():
            for c, to in steps[s].items():
                owner[offset + c], after[offset + c] = offset, at.get(to, none)
        first = np.full(width, none, np.int32)
        for c, to in steps[0].items():
            first[c] = at.get(to, none)
        return Automaton(np.array(alphabet, np.int32), owner, after, first, size)

    @property
    def bits(self) -> float:
        """What it takes to name a phrase."""
        return math.log2(self.size + LITERALS)

    def phrases(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of lanes of text, which begin at starts; lengths do not rise."""
        codes = self.codes[text]
        state, count, place = np.full(len(starts), self.none, np.int32), np.zeros(len(starts), np.int64), starts.copy()
        active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0))  # lanes that have a symbol left
        for n in active.tolist():
            c, s = codes.take(place[:n]), state[:n]
            to = s + c
            miss = self.owner.take(to) != s
            count[:n] += miss
            state[:n] = np.where(miss, self.first.take(c), self.after.take(to))
            place[:n] += 1
        return count


def parse(automata: list[Automaton], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases by each automaton (a column) of each text, its number of symbols, and whether it has a letter.

    Texts are cut into lanes of LANE symbols; a phrase ends where its lane does.
    """
    flat, at, letters = symbols(texts)
    size = np.diff(at)
    each = -(-size // LANE)
    text = np.repeat(np.arange(len(texts)), each)
    starts = at[text] + (np.arange(len(text)) - np.repeat(np.r_[0, np.cumsum(each)][:-1], each)) * LANE
    lengths = np.minimum(LANE, at[text + 1] - starts)
    order = np.argsort(-lengths, kind="stable")
    out = np.zeros((len(texts), len(automata)), np.int64)
    for k, a in enumerate(automata):
        np.add.at(out[:, k], text[order], a.phrases(flat, starts[order], lengths[order]))
    return out, size, letters


def bits_a_symbol(automata: list[Automaton], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits a symbol by each automaton (a column) of each text, its symbols, and whether it has a letter; parsed by about HELD characters at a time."""
    phrases, size, letters = np.zeros((len(texts), len(automata)), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    some, held = [], 0

    def flush() -> None:
        own, (n, s, has) = [k for k, _ in some], parse(automata, [t for _, t in some])
        np.add.at(phrases, own, n)
        np.add.at(size, own, s)
        np.logical_or.at(letters, own, has)
        some.clear()

    for k, t in enumerate(texts):
        for i in range(0, max(1, len(t)), HELD):
            some.append((k, t[i : i + HELD]))
            held += len(some[-1][1])
            if held >= HELD:
                flush()
                held = 0
    if some:
        flush()
    return phrases * np.array([a.bits for a in automata]) / size[:, None], size, letters


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    """The automaton of a language, from the pieces drawn of it: of those of least hash, so many as make SYMBOLS symbols."""
    rows = rows.sort_values(["h", "piece"])
    pieces, left = [], SYMBOLS
    for piece in rows["piece"]:
        own = symbols([piece])[0][:left]
        pieces.append(own)
        left -= len(own)
        if left <= 0:
            break
    a = Automaton.of(pieces)
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "size": [a.size], **{c: [getattr(a, c).tobytes()] for c in ("alphabet", "owner", "after", "first")}})


def learned(docs: DataFrame, parts: int, held_out: int) -> DataFrame:
    """lang, size, alphabet, owner, after, first: an automaton for each language of docs (doc_id, text, lang), in a table.

    Labelled texts are cut into pieces; of all of a language's pieces about DRAWN * SYMBOLS characters are drawn by hash, so
    every labelled text can be, and copies of a piece count once. What a task gets is bounded by that.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "") & (fold(F.col("doc_id"), parts) != held_out)).select("lang", "text")
    sizes, _ = store(rows.groupBy("lang").agg(F.sum(F.char_length("text")).alias("chars")), "languages")  # a row a language
    rows = rows.join(sizes, "lang").withColumn("h", F.xxhash64("text"))
    limit = F.least(F.lit(1.0), DRAWN * SYMBOLS / F.col("chars")) * (1 << 30)
    drawn = F.filter(F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / PIECE).cast("int")), lambda i: F.pmod(F.xxhash64("h", i), F.lit(1 << 30)) < limit)
    pieces = rows.select("lang", "text", F.explode(drawn).alias("i")).select("lang", F.substring("text", F.col("i") * PIECE + 1, F.lit(PIECE)).alias("piece")).distinct()
    made = pieces.withColumn("h", F.xxhash64("piece")).groupBy("lang").applyInPandas(_built, "lang string, size bigint, alphabet binary, owner binary, after binary, first binary")
    return store(made, "automata")[0]


def _read(row) -> Automaton:
    return Automaton(*[np.frombuffer(row[c], np.int32) for c in ("alphabet", "owner", "after", "first")], row["size"])


def _scored(sent, last: bool):
    """Rows (doc_id, text, best, bits, weight), brought up to date by the automata sent: the best language so far, its bits a symbol, and the sum of all languages' weights against it. The last ones need the text no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, automata = [r["lang"] for r in sent.value], [_read(r) for r in sent.value]
        for b in batches:
            best, was, weight = b.column(2).to_pylist(), np.asarray(b.column(3)), np.asarray(b.column(4))
            bits, size, letters = bits_a_symbol(automata, [t or "" for t in b.column(1).to_pylist()])
            own, low, trust = bits.argmin(axis=1), np.minimum(bits.min(axis=1), was), np.minimum(size, EVIDENCE)  # the first of equals: names are in order
            weight = np.exp2((low[:, None] - bits) * trust[:, None]).sum(axis=1) + np.where(weight > 0, weight * np.exp2((low - np.where(weight > 0, was, low)) * trust), 0)
            for k in np.flatnonzero(letters & (low < was)).tolist():
                best[k] = names[own[k]]
            columns = [b.column(0), b.column(1), pa.array(best, pa.string()), pa.array(np.where(letters, low, np.inf)), pa.array(np.where(letters, weight, 0.0))]
            names_out = ["doc_id", "text", "best", "bits", "weight"]
            keep = [k for k, c in enumerate(names_out) if not (last and c == "text")]
            yield pa.RecordBatch.from_arrays([columns[k] for k in keep], [names_out[k] for k in keep])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", parts: int = 4, held_out: int = 2, at_once: int = AT_ONCE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs.

    Learns from texts with a lang whose crc32(doc_id) modulo parts is not held_out; a document's own lang, id and source do
    not enter its prediction. Texts that are null or have no letter, and all where nothing is learned, are und with score 0.
    The score is the share of the language found, by 2 ** -(bits of up to EVIDENCE symbols), among all. Ties go to the first
    language by UTF-8. More than at_once languages are parsed in turns, rows kept as a table between them. Repeated rows each
    get their own; an empty table gives none; other columns are left aside.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    with dropped_after(spark, keep := []):
        automata = learned(docs, parts, held_out)
        names = sorted(r["lang"] for r in automata.select("lang").collect())
        rows = docs.select("doc_id", "text", F.lit(None).cast("string").alias("best"), F.lit(float("inf")).alias("bits"), F.lit(0.0).alias("weight"))
        for k in range(0, len(names), at_once):
            if k:
                rows, path = store(rows, "parsed-so-far")
                keep[:] = [path]
            sent = spark.sparkContext.broadcast([r.asDict() for r in automata.where(F.col("lang").isin(names[k : k + at_once])).orderBy("lang").collect()])
            last = k + at_once >= len(names)
            rows = rows.mapInArrow(_scored(sent, last), (rows.drop("text") if last else rows).schema)
    found = F.col("best").isNotNull()
    return rows.select(
        "doc_id", (fold(F.col("doc_id"), parts) == held_out).alias("held_out"),
        F.coalesce("best", F.lit(UNDETERMINED)).alias("lang_pred"), F.when(found, 1 / F.col("weight")).otherwise(F.lit(0.0)).alias("score"),
    )


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
