"""Exact, near and substring deduplication against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from quireworks.llm import exact_dedup, minhash, queries, repeats

DOCS = "doc_id long, text string, lang string, group string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(7)
    base = [words(rng, rng.randint(1, 300)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[3]) for i in range(60)]  # a hot group
    rows += [(200, None), (201, ""), (202, "x"), (None, base[5]), (203, base[5]), (203, base[5])]
    long = words(rng, 9000)
    rows += [(300, long), (301, long), (302, long[:-1] + "!"), (303, long + " z"), (304, long[:64]), (305, long[:64])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "g") for i, t in rows], DOCS)


def test_exact_classes_equal_brute_force(spark, docs):
    got = {}
    for r in exact_dedup.exact_classes(frame(spark, docs)).collect():
        got.setdefault(r["doc_id"], set()).add((r["keep_id"], r["group_size"], r["kept"]))
    groups = {}
    for i, t in docs:
        groups.setdefault(t or "", []).append(i)
    want = {}
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want.setdefault(i, set()).add((keep, len(ids), i == keep))
    assert got == want


def test_exact_of_empty_table_and_one_row_per_class(spark, docs):
    assert exact_dedup.exact_classes(frame(spark, [])).count() == 0
    kept = exact_dedup.drop_copies(frame(spark, docs))
    assert kept.columns == ["doc_id", "text", "lang", "group"]
    texts = [r["text"] or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t in docs})


def brute_removed(texts, threshold):
    seen = {}
    for d, t in enumerate(texts):
        for s in range(len(t) - threshold + 1):
            seen.setdefault(t[s : s + threshold], []).append((d, s))
    cover = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, s in places:
                cover[d][s : s + threshold] = b"\1" * threshold
    return cover


def planted(seed):
    rng = random.Random(seed)
    passage = [words(rng, 30) for _ in range(3)]
    texts = []
    for _ in range(25):
        t = words(rng, rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passage)
            p = p[rng.randint(0, 20) : len(p) - rng.randint(0, 20)]
            if rng.random() < 0.4:
                at = rng.randrange(len(p))
                p = p[:at] + "#" + p[at + 1 :]
            at = rng.randint(0, len(t))
            t = t[:at] + p + t[at:]
        texts.append(t)
    texts += [texts[0], texts[1], texts[1], "é" * 200, "ab" * 150, "", "q" * 59, "q" * 60, None, texts[2][:60]]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    texts = planted(seed)
    threshold = 60
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in repeats.removal_report(frame(spark, rows), threshold, 16).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, cover in enumerate(brute_removed(raw, threshold)):
        kept = bytes(b for b, c in zip(raw[i], cover, strict=True) if not c)
        runs = sum(1 for j, c in enumerate(cover) if c and not (j and cover[j - 1]))
        want = (len(raw[i]), sum(cover), runs, hashlib.sha256(kept).hexdigest())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want, i
        assert got[i]["text"] == kept.decode("utf-8", "ignore")


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_within_the_report_equal_brute_force(spark, seed):
    texts = planted(seed)
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in repeats.removal_report(frame(spark, rows), 60, 16, passage=36).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, (long, short) in enumerate(zip(brute_removed(raw, 60), brute_removed(raw, 36), strict=True)):
        left = [bytes(b for b, c in zip(raw[i], cover, strict=True) if not c) for cover in (long, short)]
        runs = sum(1 for j, c in enumerate(long) if c and not (j and long[j - 1]))
        r = got[i]
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == (sum(long), runs, hashlib.sha256(left[0]).hexdigest()), i
        assert (r["n_passage_bytes"], r["text"], r["passage_free_text"]) == (sum(short), *(t.decode("utf-8", "ignore") for t in left)), i


def test_op8_shows_passages_of_over_50_words_that_400_bytes_leave(spark, tmp_path):
    rng = random.Random(5)
    passage = words(rng, 55)
    assert repeats.PASSAGE < len(passage) < repeats.THRESHOLD - 20
    alone = words(rng, 300)
    rows = [(i, words(rng, 80) + " @ " + passage + " @ " + words(rng, 80)) for i in range(3)] + [(3, alone), (4, None), (None, alone[:200])]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op8_suffix_dedup(spark, str(tmp_path)).collect()}
    for i, t in rows:
        assert (got[i]["n_removed"], got[i]["text"]) == (0, t or ""), i
        want = t.replace(" @ " + passage + " @ ", "") if i in (0, 1, 2) else t or ""
        assert got[i]["passage_free_text"] == want and got[i]["n_passage_bytes"] == len(t or "") - len(want), i


def test_repeats_across_steps(monkeypatch):
    rng = random.Random(3)
    text = words(rng, 400).encode()
    whole = list(repeats.Anchors(60, 16)(text))
    monkeypatch.setattr(repeats, "STEP", 97)
    assert list(repeats.Anchors(60, 16)(text)) == whole
    assert [w for lo, hi, _, _ in whole for w in range(lo, hi + 1)] == list(range(len(text) - 59))


def test_repeats_of_rows_with_null_and_repeated_ids(spark):
    t = words(random.Random(1), 40)
    rows = [(None, t), (None, t + "x"), (5, t), (5, t), (6, "short")]
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in repeats.removal_report(frame(spark, rows), 60, 16).collect())
    n = len(t)
    assert got == sorted([(-1, n, n), (-1, n + 1, n), (5, n, n), (5, n, n), (6, 5, 0)])
    clash = frame(spark, rows).selectExpr("doc_id", "text", "lang as k", "group as spans")
    out = repeats.remove_repeats(clash, 60, 16)
    assert out.columns == ["doc_id", "text", "k", "spans"] and sorted(r["text"] for r in out.collect()) == ["", "", "", "short", "x"]
    assert repeats.removal_report(frame(spark, []), 60, 16).count() == 0


def plain_shingles(text):
    """Shingles of a text and how often each occurs, as tuples of words."""
    text = "".join(c if c.isalnum() or ord(c) >= 128 else " " for c in (text or "").lower()).split(" ")
    found = [w for w in text if w]
    if 0 < len(found) < 5:
        return Counter([tuple(found)])
    return Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))


def weights_of(texts):
    """Weighted shingles of each text: frequency times inverse document frequency, counted plainly."""
    found = [plain_shingles(t) for t in texts]
    frequency = Counter(s for f in found for s in f)
    idf = {s: 1 + math.log(max(n / len(texts), minhash.FLOOR)) / math.log(minhash.FLOOR) for s, n in frequency.items()}
    return [{s: n * idf[s] for s, n in f.items()} for f in found]


def weighted_jaccard(one, two):
    keys = one.keys() | two.keys()
    return sum(min(one.get(k, 0), two.get(k, 0)) for k in keys) / max(sum(max(one.get(k, 0), two.get(k, 0)) for k in keys), 1e-300)


def brute_classes(rows, alike=None):
    """Root of each row's class by links of 0.8 or more between all pairs (``alike`` narrows them)."""
    weights, parent = weights_of([t for _, t in rows]), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike and not alike(rows[i], rows[j]) or root(i) == root(j):
                continue
            if (rows[i][1] or "") == (rows[j][1] or "") or weighted_jaccard(weights[i], weights[j]) >= 0.8:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def test_shingles_equal_plain_ones():
    rng = random.Random(2)
    texts = [words(rng, rng.randint(0, 40)) for _ in range(200)] + ["", "a", "Ä b, c!", "x " * 50, "ÉCOLE école Öl" * 3, "one\ttwo\nthree four five six"]
    h, n, sizes = minhash.Shingler()([t.encode() for t in texts])
    ends = np.cumsum(sizes)
    named = {}
    for text, size, end in zip(texts, sizes, ends, strict=True):
        plain = plain_shingles(text)
        assert sorted(n[end - size : end]) == sorted(plain.values())
        one = minhash.Shingler()([text.encode()])
        assert (one[0] == h[end - size : end]).all() and (one[1] == n[end - size : end]).all()
        for value, of in zip(one[0].tolist(), [set(plain)] * len(plain), strict=True):
            named.setdefault(value, []).append(of)
    assert len(named) == len({s for t in texts for s in plain_shingles(t)})
    assert all(set.intersection(*of) for of in named.values())


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = words(rng, rng.choice([30, 80, 200])).split()
        for c in range(rng.choice([1, 2, 5, 20])):
            t = list(base)
            for _ in range(c % 4):
                t[rng.randrange(len(t))] = "edit" + str(rng.random())[2:6]
            rows.append((1000 * g + c, " ".join(t)))
    rows += [(90001, ""), (90002, None), (90003, "one two"), (90004, "One, two!"), (90005, "three"), (None, rows[0][1])]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    ids, roots = {}, brute_classes(rows)
    for (d, _), r in zip(rows, roots, strict=True):
        ids.setdefault(r, []).append(d)
    assert got == {d: None if None in ids[r] else min(ids[r]) for (d, _), r in zip(rows, roots, strict=True)}
    kept = minhash.drop_near_copies(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "group"] and kept.count() == len(ids)


def test_frequencies_are_exact_from_the_floor_on(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FLOOR", 0.05)
    rng = random.Random(6)
    line = [words(rng, 9) for _ in range(4)]
    texts = [words(rng, 30) + "".join(" " + p for i, p in enumerate(line) if rng.random() < 0.02 * 4**i) for _ in range(300)]
    found = minhash.frequencies(spark.createDataFrame([(t.encode(),) for t in texts], "b binary").repartition(3))
    plain = Counter(s for t in texts for s in plain_shingles(t))
    least = math.ceil(0.05 * 300)
    assert sorted(found.factors) == pytest.approx(sorted(1 + math.log(n / 300) / math.log(0.05) for n in plain.values() if n >= least))
    assert len(found.shingles) > 5


def test_sampling_follows_weighted_jaccard():
    rng = np.random.default_rng(0)
    same, want = [], []
    for n in (3, 40, 700):
        h = np.sort(rng.integers(0, 2**63, n, dtype=np.uint64))
        v = np.where(np.arange(n) % 3 == 0, 2.0, 1 + rng.random(n))
        w = v * np.where(np.arange(n) % 4 == 0, 0.5, 1.0)
        parts = [np.sort(rng.integers(0, 2**63, n, dtype=np.uint64)) for _ in range(60)]
        one, two = (minhash.samples(np.concatenate(parts), np.tile(x, 60), np.full(60, n)) for x in (v, w))
        same.append((one == two).mean())
        want.append(np.minimum(v, w).sum() / np.maximum(v, w).sum())
        # a text's samples do not depend on the texts around it
        assert (minhash.samples(parts[7], v, np.array([n]))[0] == one[7]).all()
    assert np.abs(np.array(same) - want).max() < 0.035


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_recall_of_bands(similarity):
    rng = np.random.default_rng(5)
    found = []
    for n in (60, 200, 600):
        both = round(n * 2 * similarity / (1 + similarity))
        for _ in range(150):
            h = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            keys = [minhash.band_keys(minhash.samples(np.sort(x), np.full(n, 2.0), np.array([n]))) for x in (h[:n], np.concatenate([h[:both], h[n:]]))]
            found.append((keys[0] == keys[1]).any())
    assert np.mean(found) > 0.985


def test_links_that_leave_out_the_hub(spark):
    rng = random.Random(5)
    rows = []
    for g in range(40):
        n = rng.randint(175, 195)
        base = words(rng, n).split()
        places = rng.sample(range(5, n - 10, 6), 19)
        for c in range(14):  # the larger class, which has the hub
            t = list(base)
            t[places[c]] = f"edit{g}x{c}"
            rows.append((1000 * g + c, " ".join(t)))
        for at in places[14:16]:
            base[at] = f"other{g}x{at}"
        for c in range(2):  # linked with each other only
            t = list(base)
            for at in places[16 + c : 17 + 2 * c]:
                t[at] = f"more{g}x{c}x{at}"
            rows.append((1000 * g + 100 + c, " ".join(t)))
    roots = brute_classes(rows, lambda x, y: x[0] // 1000 == y[0] // 1000)
    ids = {}
    for (d, _), r in zip(rows, roots, strict=True):
        ids.setdefault(r, []).append(d)
    want = {d: min(ids[r]) for (d, _), r in zip(rows, roots, strict=True)}
    assert sum(c % 1000 == 100 for c in want.values()) > 20
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == want


def test_near_copies_of_null_and_repeated_ids(spark):
    rng = random.Random(4)
    a, b, c, d, e = (words(rng, 60) for _ in range(5))
    near = a + " more"
    # None and 7 repeat with different texts; 7 also stands for a class whose other texts have larger ids
    rows = [(None, a), (None, b), (None, None), (None, b), (7, c), (7, d), (7, d), (8, near), (9, c), (10, e), (11, d + " more"), (12, "")]
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in minhash.drop_near_copies(frame(spark, rows)).collect())
    assert got == sorted([(-1, a), (-1, b), (-1, ""), (7, c), (7, d), (10, e)])


def test_near_of_empty_table(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
