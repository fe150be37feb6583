"""WordPiece, repair of wrongly decoded text, the collator, blocks by any kind of id, saved pages, splits, progress."""

import json
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenrec import errors
from lumenrec.functions import text as tx
from lumenrec.functions.wordpiece import CLS, MASK, PAD, SEP, UNKNOWN, WordPiece, decode, encode, read_vocabulary
from lumenrec.operators import blocks
from lumenrec.sources import paged, records
from lumenrec.sources.progress import BatchProgress, counted

SIGNS = "abcdeé!?.-世界 \tÁ​'"


def invented(seed, size=120):
    rng = random.Random(seed)
    made = [PAD, UNKNOWN, CLS, SEP, MASK, "!", "?", ".", "世", "a", "b", "c", "##a", "##b"]
    made += ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(size)]
    made += ["##" + "".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(size)]
    return list(dict.fromkeys(made))


def other(vocabulary, lower=True):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer(tokenizers.models.WordPiece({w: k for k, w in enumerate(vocabulary)}, unk_token=UNKNOWN, max_input_chars_per_word=100))
    t.normalizer = tokenizers.normalizers.BertNormalizer(lowercase=lower, strip_accents=lower)
    t.pre_tokenizer = tokenizers.pre_tokenizers.BertPreTokenizer()
    t.decoder = tokenizers.decoders.WordPiece(prefix="##", cleanup=False)
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(SIGNS) | st.characters(max_codepoint=0x24FF, blacklist_categories=["Cs", "Cn", "Co", "Cf"]), max_size=40), st.integers(0, 3))
def test_ids_are_those_of_another_tokenizer(text, seed):
    own, them = WordPiece(invented(seed)), other(invented(seed))
    assert own.ids(text) == them.encode(text, add_special_tokens=False).ids


def test_case_and_long_words():
    own, them = WordPiece(invented(1), lower=False), other(invented(1), lower=False)
    for text in ("abc ABC é", "a" * 100, "a" * 101, "b" * 99 + " c", "", "\0� a"):
        assert own.ids(text) == them.encode(text, add_special_tokens=False).ids


def brute(vocabulary, word):
    out, at = [], 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
        if end is None:
            return [UNKNOWN]
        out.append(("##" if at else "") + word[at:end])
        at = end
    return out


def test_pieces_are_the_longest_from_the_left():
    rng = random.Random(2)
    vocabulary = invented(2)
    own = WordPiece(vocabulary)
    for _ in range(500):
        word = "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9)))
        assert [vocabulary[k] for k in own.pieces(word)] == brute(set(vocabulary), word)


def test_padding_and_decoding_in_spark(spark, tmp_path):
    vocabulary = invented(3)
    (tmp_path / "v.txt").write_text("\n".join(vocabulary) + "\n", encoding="utf-8")
    assert read_vocabulary(spark, str(tmp_path / "v.txt")) == vocabulary
    own, them = WordPiece(vocabulary), other(vocabulary)
    texts = ["abc a!", None, "", "a " * 50, "世 b"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "n int, text string")
    got = {r.n: r for r in df.select("n", encode(F.col("text"), own, 12).alias("t")).select("n", "t.*").withColumn("back", decode(F.col("input_ids"), own)).collect()}
    for k, t in enumerate(texts):
        ids = [own.number[CLS], *them.encode(t or "", add_special_tokens=False).ids[:10], own.number[SEP]]
        assert got[k].input_ids == ids + [0] * (12 - len(ids)) and got[k].attention_mask == [1] * len(ids) + [0] * (12 - len(ids))
        assert got[k].back == them.decode([i for i in ids if i not in own.special], skip_special_tokens=False)
    with pytest.raises(ValueError, match="lacks"):
        WordPiece(["a"])


# -- repair ----------------------------------------------------------------------------------------------------------

TEXTS = [
    "Der Fluß fließt über Hügel – „schön“, 5 €", "L’été, où çà ? déjà vu… cœur", "¿Qué pasó mañana? ¡Año!", "naïve café “quoted” it’s", "世界 и мир", "ÿ Ž š", "plain",
]


def misread(text):
    return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode())


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("times", [0, 1, 2, 3])
def test_misread_text_is_repaired(text, times):
    broken = text
    for _ in range(times):
        broken = misread(broken)
    assert tx.repaired(broken) == text


@settings(max_examples=300)
@given(st.text(st.characters(min_codepoint=0x20, max_codepoint=0x2FFF, blacklist_categories=["Cs"]), max_size=20))
def test_only_what_misreading_makes_is_changed(text):
    once = tx.repaired(misread(text))
    assert once == tx.repaired(text)  # either way to the same end
    for line, out in zip(text.split("\n"), tx.repaired(text).split("\n")):
        if line != out:
            assert any(line == x for x in (misread(out), misread(misread(out)), misread(misread(misread(out)))))


@pytest.mark.parametrize("unsure", ["é Ã©", "Ã", "Â", "â€", "naïve Ã©t", "Ã© ü", "\x81é"])
def test_what_is_not_sure_stays(unsure):
    assert tx.repaired(unsure) == unsure and tx.repaired(unsure + "\nÃ©") == unsure + "\né"


def test_repair_in_spark(spark):
    df = spark.createDataFrame([("Ã¼ber",), (None,), ("über",)], "t string")
    assert [r.r for r in df.select(tx.repair("t").alias("r")).collect()] == ["über", None, "über"]
    assert df.select(tx.clean_text(F.col("t")).alias("c")).first().c == "uber"


# -- blocks ----------------------------------------------------------------------------------------------------------


def test_blocks_by_any_kind_of_id(spark):
    rows = [(f"id{k:04d}", k, f"w{k} x y z") for k in range(300)]
    df = spark.createDataFrame(rows, "name string, n long, text string").repartition(5)
    by = lambda c: sorted((r.batch, r.block, tuple(r.input_ids)) for r in blocks.group_texts(df, c, blocks.tokens(F.col("text")), 16, 50).collect())
    assert by("name") == by("n") and len(by("n")) == 6 * (50 * 4 // 16)
    far = df.withColumn("n", F.when(F.col("n") > 0, F.col("n") * 1_000_003))  # with a null, and gaps
    assert blocks.group_texts(far, "n", blocks.tokens(F.col("text")), 16, 50).count() == 6 * (50 * 4 // 16)


@pytest.fixture(scope="module")
def blocked(spark):
    rng = random.Random(8)
    rows = [(b, k, [rng.choice(["the", "the", "of", f"w{rng.randrange(300)}"]) for _ in range(128)]) for b in range(20) for k in range(12)]
    return spark.createDataFrame(rows, "batch long, block int, input_ids array<string>").cache()


def test_collated_shares(blocked):
    before = {(r.batch, r.block): r.input_ids for r in blocked.collect()}
    got = blocks.collate(blocked).collect()
    assert len(got) == len(before)
    asked = masked = kept = swapped = 0
    drawn = Counter()
    for r in got:
        for old, new, label in zip(before[r.batch, r.block], r.input_ids, r.labels, strict=True):
            assert label in (None, old) and (label is not None or new == old)
            asked += label is not None
            masked += new == "[MASK]"
            kept += label is not None and new == old
            if label is not None and new not in ("[MASK]", old):
                swapped += 1
                drawn[new] += 1
    n = 128 * len(got)
    assert abs(asked / n - 0.15) < 0.01 and abs(masked / asked - 0.8) < 0.02
    assert drawn["the"] > 0.3 * swapped and len(drawn) > 50  # as often as they occur
    assert abs((swapped + kept) / asked - 0.2) < 0.02 and kept > swapped / 2
    assert sorted(map(str, blocks.collate(blocked.repartition(7)).collect())) == sorted(map(str, got))
    assert sorted(map(str, blocks.collate(blocked, seed=1).collect())) != sorted(map(str, got))


def test_spans_are_counts_end_to_end(blocked):
    counts = Counter(t for r in blocked.collect() for t in r.input_ids)
    spans = sorted((r.lo, r.hi, r.token) for r in blocks.token_spans(blocked).collect())
    assert {t: hi - lo for lo, hi, t in spans} == counts
    assert [lo for lo, _, _ in spans] == [0, *(hi for _, hi, _ in spans[:-1])]


# -- sources ---------------------------------------------------------------------------------------------------------


def page(offset, n, more):
    entries = [{"node": {"id": offset + k, "title": f"t{offset + k}", "synopsis": "a\nb"}} for k in range(n)]
    return json.dumps({"offset": offset, "data": entries, "paging": {"next": "x"} if more else {}})


def test_saved_pages_are_whole_or_refused(spark, tmp_path):
    def saved(name, *lines):
        (tmp_path / name).mkdir()
        for k, line in enumerate(lines):
            (tmp_path / name / f"p{k}.json").write_text(line + "\n")
        return str(tmp_path / name)

    read = lambda path: sorted((r.id, r.synopsis) for r in records.saved_items(spark, path, short=True, page=3).collect())
    assert read(saved("whole", page(3, 2, False), page(0, 3, True))) == [(k, "a b") for k in range(5)]
    for name, lines in {"first": [page(3, 2, False)], "middle": [page(0, 3, True), page(6, 1, False)], "last": [page(0, 3, True)]}.items():
        with pytest.raises(FileNotFoundError, match="has 1|has 2"):
            read(saved(name, *lines))
    with pytest.raises(FileNotFoundError):
        read(str(tmp_path / "nothing"))


def test_files_of_this_machine_alone(tmp_path):
    for k in (0, 500):
        (tmp_path / f"{k}.json").write_text(json.dumps({"data": [{"node": {"id": k}}], "paging": {"next": "x"}}))
    options = {"url": f"file://{tmp_path}", "fetcher": "lumenrec.sources.paged:file_fetcher"}
    assert [o for o, _ in paged.pages(options, 0)] == [0, 500]
    (tmp_path / "1500.json").write_text("{}")
    with pytest.raises(FileNotFoundError, match="later ones"):
        list(paged.pages(options, 0))
    with pytest.raises(ValueError, match="not a folder of this machine"):
        list(paged.pages(options | {"url": "hdfs://host/pages"}, 0))


def test_failures_are_told_by_their_status():
    for status, kind in errors.STATUS_ERRORS.items():
        with pytest.raises(kind) as e:
            errors.check_status(status, "x")
        assert errors.failure_in(f"some trace: {e.value} and more") is kind
    assert errors.failure_in("UserNotFound") is None and errors.failure_in("service status 500") is None


def test_splits(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1, "text": "p"}, {"x": 2, "text": "q"}]')
    (tmp_path / "b.json").write_text('[{"text": "r", "y": 2.5}]')
    got = records.read_splits(spark, {"train": str(tmp_path / "a.json"), "test": str(tmp_path / "b.json")})
    assert list(got) == ["train", "test"] and got["train"].dtypes == got["test"].dtypes
    assert sorted(r.x for r in got["train"].collect()) == [1, 2] and [(r.x, r.text, r.y) for r in got["test"].collect()] == [(None, "r", 2.5)]
    with pytest.raises(FileNotFoundError, match="split test"):
        records.read_splits(spark, {"train": str(tmp_path / "a.json"), "test": str(tmp_path / "c.json")})


def test_progress(spark, tmp_path):
    df, seen = counted(spark.range(1000).where("id % 2 = 0"), "evens", largest=F.max("id"))
    df.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"rows": 500, "largest": 998}
    said = []
    listener = BatchProgress(lambda *x: said.append(x))
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "out"))
        run = stream.writeStream.format("noop").queryName("told").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        for _ in range(50):
            if listener.rows.get("told", 0) == 500:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.rows["told"] == 500 == sum(x[2] for x in said) and {x[0] for x in said} == {"told"}


def test_separators_of_lines_and_paragraphs_are_blanks():
    own, them = WordPiece(invented(0)), other(invented(0))
    for text in ("\u2028", "a\u2028b", "a \u2029 b\u2029"):
        assert own.ids(text) == them.encode(text, add_special_tokens=False).ids
