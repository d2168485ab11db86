"""Tokenization, packing, scoring and quality against public libraries and brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from quireworks.llm import brown, packing, pieces, quality

TEXTS = [
    None, "", " ", "a", "Hello  world\n\n\tfoo", "  lead and trail  ", "naïve café ÀÉ Straße", "1234 5.6% $$$ ### <|x|>", "日本語 テスト ☃ 😀 ﬁ",
    "don't we'll I'm THEY'VE", "▁ mark ▁▁ run     five", "tab\tnew\nline\r\n", "é combining", "a" * 300, "é" * 50 + " " + "x y z " * 40, " nbsp　wide"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


def test_word_tokenizer_equals_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    rng = random.Random(1)
    odd = ["a<|endoftext|>b", "<|startoftext|>", "<|ENDOFTEXT|>", "x <|endoftext|> <|endoftext", "<|<|endoftext|>|>", "a'\u058bb a'\u0378c", "\x00\x01 a\x7fb", "\u00a0x\u2028y \u3000 z", "e\u0301 \u0301 \u212b", "\ufffd\U000e0001"]
    odd += ["".join(rng.choice(["a", "'", "s", "<|", "endoftext", "|>", " ", "\n", "é", "\u0301", "9", "$", "İ", "ß", "日", "\u058b", "\u200d", "ll"]) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    odd += [chr(c) + "a'" + chr(c) + "s" + chr(c) for c in [*range(0, 0x700), *rng.sample(range(0xE000, 0x20000), 1500)]]
    for t in TEXTS[1:] + odd:
        assert np.frombuffer(own(t.encode()), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_names_of_other_columns_do_not_clash(spark):
    rows = [(1, 0, 3, 7, 8, "a"), (1, 0, 3, 7, 8, "a"), (None, 0, 4, 7, 8, "b")]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long, sequence_id int, _b long, n string"), 5)
    assert found.columns == ["doc_id", "piece", "length", "_b", "n", "sequence_id", "offset"]
    assert sorted((r["n"], r["_b"], r["offset"]) for r in found.collect()) == [("a", 8, 0), ("a", 8, 0), ("b", 8, 0)]


def test_pieces_and_places(spark):
    rng = random.Random(5)
    texts = TEXTS + [" ".join("word" for _ in range(rng.choice([3, 50, 400, 9000]))) for _ in range(120)]
    found = packing.token_pieces(frame(spark, texts), public_tokenizers.path("word_bpe_49k.json"), capacity=512).cache()
    rows = packing.pack(found, 512).collect()
    own = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    joined = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == len(joined.setdefault(r["doc_id"], b"")) // 4 and r["length"] == len(r["ids"]) // 4 <= 512
        joined[r["doc_id"]] += bytes(r["ids"])
    assert joined == {i: own((t or "").encode()) + b"\1\0\0\0" for i, t in enumerate(texts)}
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    room: list[int] = []
    for n in sorted((r["length"] for r in rows), reverse=True):  # first fit decreasing
        at = next((i for i, x in enumerate(room) if x >= n), None)
        if at is None:
            room.append(512)
            at = -1
        room[at] -= n
    assert len(by) <= len(room)
    assert packing.pack(found.limit(0), 512).count() == 0


def test_batches_of_texts_and_pieces_are_bounded(spark, monkeypatch):
    # 300 texts of 80 KB: batches of 10,000 rows or 64 MB would hold them all, and so would 2,000 pieces
    docs = spark.range(300, numPartitions=1).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), 80000 div (2 + length(string(id)))) as text")
    path = public_tokenizers.path("word_bpe_49k.json")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, sent, step = spark.conf.get(name), packing.lean, []
    monkeypatch.setattr(packing, "lean", lambda f: step.append(f) or sent(f))

    def sizes(batches):
        took = []

        def seen():
            for b in batches:
                took.append(int(b["b"].map(len).sum()))
                yield b

        for out in step[0](seen()):
            yield pd.DataFrame({"took": [took[-1]], "gave": [int(out["ids"].map(len).sum())], "n": [len(took)]})

    try:
        packing.token_pieces(docs, path)
        rows = docs.selectExpr("doc_id", "cast(text as binary) as b").mapInPandas(sizes, "took long, gave long, n long").collect()
    finally:
        spark.conf.set(name, before)
    assert max(r["n"] for r in rows) > 3 and max(r["took"] for r in rows) < 6 << 20
    assert max(r["gave"] for r in rows) < packing.FLUSH_BYTES + 4 * packing.CAPACITY


def test_a_part_that_is_a_word_is_remembered_once():
    own = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    own(b"quill ledger")
    whole = own(b"ledger, Ledger quill.")
    assert set(own.parts) == {b",", b"."} and {b"quill", b"ledger", b"ledger,"} <= set(own.words)
    assert whole == b"".join(own(w) for w in (b"ledger", b",", b"ledger", b"quill", b"."))


def test_a_batch_of_texts_is_encoded_by_one_call():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, own, calls = Tokenizer.from_file(path), packing.WordTokenizer(path), []

    class Counted:
        def __init__(self, name, of):
            self.name, self.of = name, of

        def __getattr__(self, name):
            return lambda seen, **more: calls.append((self.name, seen)) or getattr(self.of, name)(seen, **more)

    own.library, own.merges = Counted("library", own.library), Counted("merges", own.merges)
    texts = ["Le CAFÉ, déjà vu.", "", "café naïve 日本 it's", " \n\t", "vu\x0bdéjà\x0cŒuvre ŁÓDŹ l'été 3½"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    # words of Latin letters are no matter of the normaliser; each part goes to the library once
    (first, parts), (second, rest) = calls
    assert (first, second) == ("merges", "library") and len(parts[0].split(" ")) == len(set(parts[0].split(" ")))
    assert sorted(rest.split(" ")) == ["3½", "日本"]
    calls.clear()
    assert list(own.encode([])) == [] and list(own.encode([t.encode() for t in texts[::-1]])) and not calls
    rng, letters = random.Random(3), [*map(chr, range(0xC0, 0x180)), "a", "S", "'", "'s", "'ll", ".", "7", " ", "\u0301", "\x1f", "\u0085", "<|", "</w>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plan_places_everything(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.geometric(0.004, 5000), 512)
    histogram = np.bincount(lengths, minlength=513)
    plan = packing.make_plan(histogram, 512)
    fill = np.zeros(plan.n_sequences, int)
    for n in np.flatnonzero(histogram):
        rank = np.arange(histogram[n])
        run = np.searchsorted(plan.ranks[n], rank, side="right") - 1
        np.add.at(fill, plan.sequences[n][run] + rank - plan.ranks[n][run], n)
    assert fill.max() <= 512 and fill.sum() == lengths.sum()
    assert plan.n_sequences <= 1.01 * lengths.sum() / 512 + 1


def test_pieces_equal_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    plain, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    rng = random.Random(2)
    more = ["".join(rng.choice("the quick andton iestr ▁.,\n  ß1") for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    for t in TEXTS[1:] + more:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t), t
        assert own.decode(ids) == plain.decode(plain.encode(t)), t


def test_unigram_pass_finds_the_best_sum():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = pieces.PieceModel(path)
    proto = pb.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    proto.trainer_spec.byte_fallback = True
    for p in proto.pieces:
        p.score = -len(p.piece) ** 0.5 - 3 + (hash_of(p.piece) % 997) / 997
    plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    own.unigram = True
    own.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
    own.value = [own.score[p] for p in own.name]
    own.automaton = type(own.automaton)()
    for rank, piece in enumerate(own.name):
        own.automaton.add_word(piece, (rank, len(piece)))
    own.automaton.make_automaton()
    rng = random.Random(4)
    for _ in range(300):
        word = "▁" + "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 14)))
        got = own.relax(word)
        best = plain.encode(word[1:], out_type=str)
        assert abs(sum(own.score[p] for p in got) - sum(own.score[p] for p in best)) < 1e-3


def hash_of(piece):
    return zlib.crc32(piece.encode())


def test_encoded_texts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = pieces.encode_texts(frame(spark, TEXTS), path).collect()
    assert [r["decoded"] for r in sorted(got, key=lambda r: r["doc_id"])] == [(t or "").replace("▁", " ") for t in TEXTS]


def brute_statistics(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(found), sum(map(len, found)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_statistics_equal_brute_force(spark):
    rng = random.Random(9)
    texts = TEXTS + [" ".join(rng.choice(["a", "bé", "#", "c\nd", "e f"]) for _ in range(rng.randint(0, 90))) for _ in range(60)] + ["x\n\nx\n \nx \nx"]
    got = quality.judge(frame(spark, texts), None).select("doc_id", "verdict.*").collect()
    for r in got:
        n, *rest = want = brute_statistics(texts[r["doc_id"]] or "")
        assert tuple(r[c] for c in quality.COUNTS) == want, texts[r["doc_id"]]
        assert r["base_failed"] == (n < 50 or 100 * rest[-1] > 50 * n) and r["kept"] == (not r["base_failed"])


def test_trees_are_monotonic_and_accurate():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * rng.standard_normal(3000)) > 0.6).astype(float)
    trees = quality.fit_trees(x[:2000], y[:2000], rising=(0,))
    score = trees.score(x)
    assert ((score[2000:] > 0) == y[2000:]).mean() > 0.85
    steps = np.repeat(x[:200], 21, 0)
    steps[:, 0] = np.tile(np.linspace(0, 1, 21), 200)
    assert (np.diff(trees.score(steps).reshape(200, 21), axis=1) >= -1e-9).all()

    def walk(row):
        total = trees.start
        for f, c, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > c[at] else 1)
            total += leaf[at - len(f)]
        return total

    assert np.allclose([walk(r) for r in x[:50]], score[:50])


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit_model(frame(spark, TEXTS), labels) is None


def test_estimates_follow_the_shares_of_all_labels(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(80)) for _ in range(600)]
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    # texts say nothing about the labels: a tenth is bad, however many of each class are sampled
    for limit in (60, 100, 6000):
        model = quality.fit_model(frame(spark, texts), labels, limit)
        assert abs(model.start - np.log(60 / 540)) < 1e-6
        kept = quality.judge(frame(spark, texts), model).filter("verdict.kept").count()
        assert kept > 500
    few = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    assert quality.fit_model(frame(spark, texts), few) is not None


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hash_of_word(word):
    return int(brown.Words()([word.encode()])[0][0])


@pytest.mark.parametrize("sizes", [(40, 50, 55), (10, 20, 1000), (40, 50, 0)])
def test_scores_equal_brute_force(spark, sizes):
    rng = random.Random(3)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    texts = [" ".join(w for _ in range(rng.randint(2, 30)) for w in (rng.choice(nouns), rng.choice(verbs))) for _ in range(300)] + [None, "", "UNSEEN word N1 é"]
    model = brown.ClassModel(frame(spark, texts), *sizes, n_classes=4)
    got = {r["doc_id"]: r for r in model.score().collect()}
    words = [words_of(t) for t in texts]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    count = Counter(x for w, h in zip(words, held, strict=True) if not h for x in [*w, None])
    n, v = sum(count.values()), len(count)
    # every training word has a class
    cls = dict(zip(model.hashes.tolist(), model.classes[model.ranks].tolist(), strict=True))
    if model.beyond is not None:
        cls |= {r["word"] % 2**64: r["cls"] for r in model.word_classes().collect()}
    of = {w: cls.get(hash_of_word(w), 4) for w in count if w is not None}
    if sizes[2]:
        assert len(cls) == v - 1 and set(of.values()) <= {0, 1, 2, 3}
    path = lambda w: [5, *(of.get(x, 4) for x in w), 5]
    steps = np.full((6, 6), brown.SMOOTH)
    for w, h in zip(words, held, strict=True):
        if not h:
            np.add.at(steps, (path(w)[:-1], path(w)[1:]), 1)
    mass = np.zeros(6)
    for w, c in of.items():
        mass[c] += count[w] + 0.1
    mass[4] += 0.1
    mass[5] = count[None] + 0.1
    chance = steps / steps.sum(1, keepdims=True)
    better = 0
    for i, w in enumerate(words):
        want = sum(np.log10((count.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None])
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w) + 1, sum(x in count for x in [*w, None]), n)
        assert abs(r["base_score"] - want) < 1e-6 * max(1, abs(want))
        p = path(w)
        score = sum(np.log10(chance[a, b] * (count.get(x, 0) + 0.1) / mass[b]) for a, b, x in zip(p[:-1], p[1:], [*w, None], strict=True))
        assert abs(r["score"] - score) < 1e-6 * max(1, abs(score))
        better += r["score"] > r["base_score"]
    assert better > 0.9 * len(texts) or not sizes[2]


def test_words_beyond_the_core_have_classes(spark):
    rng = random.Random(6)
    nouns, verbs = [f"n{i}" for i in range(200)], [f"v{i}" for i in range(200)]
    pick = lambda words: words[min(int(rng.expovariate(0.03)), 199)]
    texts = [" ".join(w for _ in range(20) for w in (pick(nouns), pick(verbs))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for sizes in ((40, 50, 60), (40, 50, 1000)):
        model = brown.ClassModel(docs, *sizes, n_classes=4)
        cls = dict(zip(model.hashes.tolist(), model.classes[model.ranks].tolist(), strict=True)) | {r["word"] % 2**64: r["cls"] for r in model.word_classes().collect()}
        sides = [{cls[h] for w in side if (h := hash_of_word(w)) in cls} for side in (nouns, verbs)]
        assert not sides[0] & sides[1]


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(0)
    pairs = np.zeros((20, 20))
    even = np.arange(0, 20, 2)
    for a in even:
        for b in even + 1:
            pairs[a, b] = rng.integers(1, 50)
            pairs[b, a] = rng.integers(1, 50)
    found = brown.Exchange(pairs, 2)
    found.of = np.arange(20) // 10
    one = np.eye(2)[found.of]
    found.table = one.T @ pairs @ one
    before = found.likelihood(found.table)
    of = found.run()
    assert found.likelihood(found.table) > before
    assert len(set(of[::2])) == len(set(of[1::2])) == 1 and of[0] != of[1]
    one = np.eye(2)[of]
    assert np.allclose(found.table, one.T @ pairs @ one)


def test_scores_of_empty_table(spark):
    assert brown.score_texts(frame(spark, []).select("doc_id", "text")).count() == 0
