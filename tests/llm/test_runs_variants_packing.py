"""Periodic runs, spelling variants and ordered packing against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wavemill.llm import ordered_packing, spelling_variants
from wavemill.llm.ordered_packing import best_cuts, op13_ordered_packing, pack_in_order, padding
from wavemill.llm.periodic_runs import find_runs, op12_periodic_runs, word_runs
from wavemill.llm.spelling_variants import count_words, op11_spelling_variants, variant_groups
from wavemill.llm.tokens import BYTE_BPE, default_path, encoder


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def documents(spark, sf):
    return rows_of(spark.read.parquet(f"{sf}/documents.parquet"))


def runs(w):
    """Every run (start, length, period), lag by lag."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, size = i - q, j - i + q
            if j > i and size >= max(6, 4 * q) and not any(all(w[x] == w[x - d] for x in range(s + d, s + size)) for d in range(1, q)):
                out.append((s, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    drop = set()
    for s, size, q in found:
        drop.update(range(s + q, s + size))
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def test_runs_of_small_alphabets():
    rng = random.Random(1)
    for _ in range(600):
        docs = []
        for _ in range(rng.randint(1, 3)):
            n = rng.randint(0, 60)
            w = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(n)]
            if n and rng.random() < 0.7:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        first = np.r_[0, np.cumsum([len(d) for d in docs])].astype(np.int64)
        got = word_runs(np.array([ord(x) for d in docs for x in d], np.int64), first)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == [(int(first[k]) + s, n, q) for k, d in enumerate(docs) for s, n, q in runs(d)]


def test_runs_of_one_word_a_hundred_thousand_times():
    n = 100_000
    assert [x.tolist() for x in word_runs(np.zeros(n, np.int64), np.array([0, n]))] == [[0], [n], [1]]
    assert [x.tolist() for x in word_runs(np.array([0, 1, 0, 2] * (n // 4)), np.array([0, n]))] == [[0], [n], [4]]


def test_runs_of_odd_documents(spark, odd_docs, no_docs):
    extra = spark.createDataFrame([(30, "a b " * 9 + "c c c c c c"), (31, "x " * 40), (30, "r\ts\n" * 3)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(extra).withColumn("runs", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["strongest"] and tuple(r["strongest"]), r["kept_text"]) for r in find_runs(docs).collect()), key=repr)
    want = []
    for i, text in rows_of(docs):
        w = brute.WORD.findall(text or "")
        found = runs(w) if len(w) < 1000 else []
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        want.append((i, len(w), found, best, collapsed(w, found)))
    assert got == sorted(want, key=repr)
    assert find_runs(no_docs).count() == 0
    with pytest.raises(ValueError):
        find_runs(docs, min_exponent=2)


def test_runs_query(spark, sf):
    want = {}
    for i, text in documents(spark, sf):
        w = brute.WORD.findall(text or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
        # lags beyond those at which anything repeats four times can't matter: plain runs for short texts, else by numpy
        if n <= 1500:
            found = runs(w)
        else:
            number = np.unique(w, return_inverse=True)[1]
            found = []
            for q in range(1, n // 4 + 1):
                ends = np.flatnonzero(np.diff(np.r_[False, number[q:] == number[:-q], False].astype(int)))
                found += [(int(s), int(e - s) + q, q) for s, e in zip(ends[::2], ends[1::2], strict=True) if e - s + q >= max(6, 4 * q)]
            found = sorted((r for r in found if not any(o[:2] == r[:2] and o[2] < r[2] for o in found)), key=lambda r: (r[0], r[2]))
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want[i] = (len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(lines), sha(collapsed(w, found)))
    got = {r[0]: tuple(r[1:]) for r in op12_periodic_runs(spark, sf).collect()}
    assert got == want and sum(v[0] for v in got.values()) > 5


def counted(rows, typo=0):
    out = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.LOWER)
            if typo:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % typo == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def grouped(words, ratio=5):
    """By deleted code points: two words are near if one less a letter is the other, or both less one at the same place are equal."""
    near, cells = defaultdict(set), defaultdict(list)
    for w in words:
        for k in range(len(w)):
            cells[w[:k] + "\0" + w[k + 1 :]].append(w)
            if w[:k] + w[k + 1 :] in words:
                near[w].add(w[:k] + w[k + 1 :])
                near[w[:k] + w[k + 1 :]].add(w)
    for group in cells.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def as_dict(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("tile", [4, 1024])
def test_variants_of_crowded_words(spark, tile, monkeypatch):
    """Few letters make nearly all words near each other; small tiles make every cell split down to one place."""
    monkeypatch.setattr(spelling_variants, "TILE", tile)
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))): rng.choice([5, 6, 30, 31, 160, 900, 5000]) for _ in range(400)}
    words |= {"a" * 6: 5, "a" * 7: 50, "a" * 8: 300, "z" * 300: 5, "z" * 299 + "y": 40, "z" * 301: 25}
    assert as_dict(variant_groups(spark.createDataFrame(list(words.items()), "word string, n long"))) == grouped(words)


def test_word_counts_of_odd_documents(spark, odd_docs, no_docs):
    extra = spark.createDataFrame([(40, "Ünïted " * 7 + "ÀÉÎõü×÷ " * 6 + "ĀbcdefgĀ " * 5 + "naïveté日本naïveté-" * 4), (None, "Nameless " * 9)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(extra)
    for typo in (0, 3):
        assert {r["word"]: r["n"] for r in count_words(docs, typo=typo).collect()} == counted(rows_of(docs), typo)
    assert count_words(no_docs).count() == 0 and variant_groups(count_words(no_docs)).count() == 0


def test_variants_query(spark, sf):
    want = grouped(counted(documents(spark, sf), 199))
    assert as_dict(op11_spelling_variants(spark, sf)) == want
    assert sum(v[3] > 0 for v in want.values()) > 5


def test_units_of_the_byte_level_tokenizer():
    rng, enc = random.Random(1), encoder(default_path(BYTE_BPE))
    pieces = [" ", "  ", "\n", "\t", "\r\n", " ", "a", "Be", "été", "12", "'s", "!?", "…", "日本", "\n\n", "<|endoftext|>", "　", "\x1c", "\x85", "ﬁ", " x", "Word."]
    for _ in range(8000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert enc.whole.encode(text, add_special_tokens=False).ids == enc.encode([text.encode()])[0].tolist(), text


def test_cuts_are_the_best():
    rng = random.Random(2)
    for _ in range(500):
        cap = rng.choice([4, 8, 16])
        places = [0]
        for _ in range(rng.randint(1, 25)):
            places.append(places[-1] + rng.randint(1, cap if rng.random() < 0.3 else 4))
        price = [0, *(rng.choice([0, 2, 5]) for _ in places[1:])]
        pad = lambda n: 0 if n & (n - 1) == 0 else cap - n
        cost = lambda a, b: pad(places[b] - places[a]) + price[b] + ordered_packing.WINDOW
        best = [0]
        for j in range(1, len(places)):
            best.append(min(best[i] + cost(i, j) for i in range(j) if places[j] - places[i] <= cap))
        got = best_cuts(np.array(places), np.array(price), cap)
        assert got[0] == 0 and got[-1] == len(places) - 1 and sum(cost(a, b) for a, b in zip(got, got[1:], strict=False)) == best[-1]


def check_pieces(rows, docs, capacity=2048, end_id=1):
    """Pieces hold every id of every document once, in sequences without gaps."""
    enc = Tokenizer.from_file(default_path(BYTE_BPE))
    want = Counter()
    ids_of = defaultdict(list)
    for i, text in docs:
        ids = [*enc.encode(text or "", add_special_tokens=False).ids, end_id]
        want[i, len(ids)] += 1
        ids_of[i, len(ids)].append(ids)
    got, spans, places = Counter(), defaultdict(list), defaultdict(list)
    for r in rows:
        if r["start"] == 0:
            got[r["doc_id"], r["doc_tokens"]] += 1
        spans[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        assert any(zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for x in ids_of[r["doc_id"], r["doc_tokens"]])
    assert got == want
    for (_, n), found in spans.items():
        cover = Counter(t for s, k in found for t in (range(s, s + k)))
        assert sorted(cover) == list(range(n)) and len(set(cover.values())) == 1
    for found in places.values():
        ends = 0
        for offset, n in sorted(found):
            assert offset == ends
            ends += n
        assert ends <= capacity


def test_ordered_packing_of_odd_documents(spark, odd_docs, no_docs, monkeypatch):
    extra = spark.createDataFrame([(None, "No name. At all!"), (50, "word " * 9000), (51, "q" * 30_000)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(extra).withColumn("start", F.lit("clash"))
    monkeypatch.setattr(ordered_packing, "STREAM", 1 << 16)
    for capacity in (2048, 256):
        rows = pack_in_order(docs.coalesce(2), capacity=capacity).collect()
        check_pieces(rows, rows_of(docs), capacity)
    assert pack_in_order(no_docs).count() == 0
    with pytest.raises(ValueError):
        pack_in_order(docs, capacity=1000)


def test_ordered_packing_query(spark, sf):
    pieces = op13_ordered_packing(spark, sf)
    check_pieces(pieces.collect(), documents(spark, sf))
    total = padding(pieces).first()
    assert total["padding"] <= 0.005 * total["tokens"]
    order = [r["doc_id"] for r in pieces.where("start = 0").orderBy("sequence_id", "offset").collect()]
    assert order == [i for i, _ in documents(spark, sf)]
