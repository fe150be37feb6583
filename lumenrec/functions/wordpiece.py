"""WordPiece: texts to ids of a given vocabulary and back. The vocabulary is a parameter; none is made here."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Names of the special tokens, the mark of a piece that goes on a word, and the longest word that is tried.
PAD, UNKNOWN, CLS, SEP, MASK = "[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"
GOES_ON, LONGEST = "##", 100
#: Blocks of ideographs, each of which is a word of its own.
IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B920, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
MOST = 1 << 18  # tokens of a vocabulary, which goes to every task
REMEMBERED = 200_000  # words that a worker keeps the ids of


def _kind(c: str) -> str:
    """space, gone, alone (a word by itself) or part of a word."""
    if c in " \t\n\r" or unicodedata.category(c) in ("Zs", "Zl", "Zp"):
        return "space"
    if c in "\0�" or unicodedata.category(c)[0] == "C":
        return "gone"
    if "!" <= c <= "/" or ":" <= c <= "@" or "[" <= c <= "`" or "{" <= c <= "~" or unicodedata.category(c)[0] == "P" or any(a <= ord(c) <= b for a, b in IDEOGRAPHS):
        return "alone"
    return "part"


class WordPiece:
    """A tokenizer over a list of tokens, whose places are their ids. lower: letters lose case and marks first."""

    def __init__(self, vocabulary: list[str], lower: bool = True):
        if len(vocabulary) > MOST:
            raise ValueError(f"{len(vocabulary)} tokens are more than {MOST}")
        self.vocabulary, self.lower = list(vocabulary), lower
        self.number = {t: k for k, t in enumerate(self.vocabulary)}
        missing = [t for t in (PAD, UNKNOWN, CLS, SEP) if t not in self.number]
        if missing:
            raise ValueError(f"the vocabulary lacks {', '.join(missing)}")
        self.special = {self.number[t] for t in (PAD, UNKNOWN, CLS, SEP, MASK) if t in self.number}
        self._kinds: dict[str, str] = {}
        self._words: dict[str, list[int]] = {}
        self._first: dict = {}
        self._later: dict = {}
        for token, k in self.number.items():
            node = self._later if token.startswith(GOES_ON) and token != GOES_ON else self._first
            for c in token.removeprefix(GOES_ON) if node is self._later else token:
                node = node.setdefault(c, {})
            node[""] = k  # no character is empty, so it marks the end of a token

    def __getstate__(self):  # a task gets the vocabulary alone, and lays it out itself
        return {"vocabulary": self.vocabulary, "lower": self.lower}

    def __setstate__(self, state):
        self.__init__(**state)

    def words(self, text: str) -> list[str]:
        """Runs of letters, digits and signs, and each punctuation mark and ideograph by itself."""
        if self.lower:
            text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()
        out, word = [], []
        for c in text:
            kind = self._kinds.get(c)
            if kind is None:
                kind = self._kinds[c] = _kind(c)
            if kind == "part":
                word.append(c)
            elif kind != "gone":
                if word:
                    out.append("".join(word))
                    word = []
                if kind == "alone":
                    out.append(c)
        return [*out, "".join(word)] if word else out

    def pieces(self, word: str) -> list[int]:
        """Ids of the longest tokens from the left; a word that cannot be made of tokens, or is too long, is unknown."""
        if len(word) > LONGEST:
            return [self.number[UNKNOWN]]
        out, at, trie = [], 0, self._first
        while at < len(word):
            node, found, end = trie, None, at
            for k in range(at, len(word)):
                node = node.get(word[k])
                if node is None:
                    break
                if "" in node:
                    found, end = node[""], k + 1
            if found is None:
                return [self.number[UNKNOWN]]
            out.append(found)
            at, trie = end, self._later
        return out

    def ids(self, text: str | None) -> list[int]:
        out = []
        for word in self.words(text or ""):
            own = self._words.get(word)
            if own is None:
                own = self.pieces(word)
                if len(self._words) < REMEMBERED:
                    self._words[word] = own
            out += own
        return out

    def padded(self, text: str | None, length: int) -> tuple[list[int], list[int]]:
        """length ids, of the start, as many of the text as fit, the end, and padding; and 1 for each that is not padding."""
        own = [self.number[CLS], *self.ids(text)[: length - 2], self.number[SEP]]
        return own + [self.number[PAD]] * (length - len(own)), [1] * len(own) + [0] * (length - len(own))

    def text(self, ids) -> str:
        """The tokens of ids, but special ones, with a space before each that does not go on a word."""
        tokens = [self.vocabulary[k] for k in ids if k not in self.special]
        return "".join(t.removeprefix(GOES_ON) if t.startswith(GOES_ON) and n else f" {t}" if n else t for n, t in enumerate(tokens))


def read_vocabulary(spark: SparkSession, path: str) -> list[str]:
    """Tokens from a text file, a line each, the first of id 0."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return text.removesuffix("\n").split("\n")


def encode(text: Column, tokenizer: WordPiece, length: int = 512) -> Column:
    """input_ids and attention_mask of a text, of one length; a null text is an empty one."""

    @F.pandas_udf("input_ids array<int>, attention_mask array<int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tokenizer.padded(t, length) for t in texts], columns=["input_ids", "attention_mask"])

    return run(text)


def decode(ids: Column, tokenizer: WordPiece) -> Column:
    """The text of ids, null for null."""

    @F.pandas_udf(StringType())
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else tokenizer.text(x))

    return run(ids)
