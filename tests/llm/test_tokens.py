"""Packing, codes, sampling, LM scores, archives and the pipeline."""

import collections
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tapeloom.llm import backoff, dac, ngrams, packing, sampling, tokens, warc
from tapeloom.llm import queries as Q

ODD = [(3, None, "s", 1), (1, "", None, 2), (2, " two  words ", "s", 3), (2, " two  words ", "s", 3), (None, "no key\n\nat all", "t", 4), (9, "word " * 3000, "s", 5)]
SCHEMA = "doc_id long, text string, source string, ids int"


def library(file):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.path(file))
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_gives_the_ids_of_whole_texts(file):
    rng, ids, mine = random.Random(3), library(file), tokens.Encoder(tokens.path(file))
    pieces = ["a", "B", "é", " ", "  ", "\n", "\t", "1", "'s", "!", "　", "\x1c", "é", "Σ", "İ", "́", "<|endoftext|>", "<|", "日", ".", "\x85", "​", "word", "!!!!!!!!!!"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(4000)] + [None]
    for _ in range(2):  # learned, then known
        assert all(got == ids(t).tobytes() for got, t in zip(mine.encode(texts), texts, strict=True))


def test_turns_equal_the_served_order():
    """Blocks sorted by the time at which they are due, one after another, and all tokens once."""
    rng = random.Random(1)
    for _ in range(300):
        totals = [rng.randrange(1, 90) for _ in range(rng.randrange(1, 6))]
        weights = [rng.choice([0, 0, 1, 2, 5]) for _ in totals]
        quantum, size = rng.randrange(1, 6), rng.randrange(5, 40)
        named = [(w, n) for w, n in zip(weights, totals, strict=True) if w]
        rest = sum(totals) - sum(n for _, n in named)
        turns = packing.Turns(named, rest, size, quantum)
        for w, n in zip(weights, totals, strict=True):
            blocks, at, want = -(-n // quantum), 0, {}
            for b in range(blocks):
                stop = (b + 1) * n // blocks
                if w:
                    v = Fraction((2 * b + 1) * n, 2 * blocks * w)
                    due = sum(min(Fraction(m), x * v) for x, m in named)
                else:
                    due = sum(m for _, m in named) + Fraction((2 * b + 1) * rest, 2 * blocks)
                want |= {t: due // size for t in range(at, stop)}
                assert stop - at <= quantum
                at = stop
            first = rng.randrange(n)
            count = rng.randrange(1, n - first + 1)
            for lo, k in ((0, n), (first, count)):
                got = {t + i: win for win, t, m in turns.runs(w, n, lo, k) for i in range(m)}
                assert got == {t: want[t] for t in range(lo, lo + k)}
            credit = lambda p: p * Fraction(n, max(1, rest))
            if not named:  # what a queue is owed never grows beyond a block
                for k in range(1, sum(totals) // size + 1):
                    assert abs(sum(win < k for win in want.values()) - credit(k * size)) <= quantum


def check_packed(rows, docs, ids, end):
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for d, text in docs.items():
        want = np.concatenate([ids(text), np.array([end], "<u4")])
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(want)) and r.ids_crc32 == zlib.crc32(want[at : at + r.length].tobytes())
            at += r.length
        assert at == len(want)
    places = sorted((r.sequence_id * packing.LENGTH + r.offset, r.length) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and places[0][0] == 0


def test_packing_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    check_packed(Q.op9_packing(spark, DATA).collect(), docs, library("byte_bpe_50k.json"), 0)


def test_windows_hold_the_mixture(spark):
    docs = spark.createDataFrame([(i, "a " * 50, "x" if i % 4 else "y") for i in range(800)], "doc_id long, text string, source string").repartition(5)
    rows = packing.pack(docs, tokens.path("byte_bpe_50k.json"), window_sequences=2).collect()
    shares = collections.Counter()
    for r in rows:
        shares[r.sequence_id // 2, r.queue] += r.length
    windows = max(w for w, _ in shares)
    assert all(abs(shares[w, "y"] - 512) <= 1 for w in range(windows))
    rows = packing.pack(docs, tokens.path("byte_bpe_50k.json"), window_sequences=2, weights={"y": 3, "x": 1}).collect()
    first = sum(r.length for r in rows if r.sequence_id < 2 and r.queue == "y")
    assert first == 1536


def test_two_thousand_sources_with_named_weights(spark):
    rows = [(i, "a " * (5 + i % 7), f"s{i % 2000}") for i in range(6000)] + [(9000 + 2 * i + j, "b " * 40, x) for i in range(60) for j, x in enumerate(("big", "small"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    found = packing.pack(docs, tokens.path("byte_bpe_50k.json"), window_sequences=1, weights={"big": 3, "small": 1}).collect()
    check_packed(found, {d: t for d, t, _ in rows}, library("byte_bpe_50k.json"), 0)
    first = collections.Counter()
    for r in found:
        if r.sequence_id < 2:
            first[r.queue] += r.length
    assert set(first) == {"big", "small"} and abs(first["big"] - 3 * first["small"]) <= 8
    last = [r.sequence_id for r in found if r.queue in ("big", "small")]
    assert max(last) <= 1 + min(r.sequence_id for r in found if r.queue.startswith("s") and r.queue != "small")


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    rows = packing.pack(df, tokens.path("byte_bpe_50k.json")).collect()
    assert sum(r.length for r in rows if r.doc_id in (1, 3)) == 2 and sum(r.start == 0 for r in rows if r.doc_id == 2) == 2
    assert packing.pack(df.limit(0), tokens.path("byte_bpe_50k.json")).count() == 0
    assert sampling.segmentations(df.limit(0), tokens.path("piece_bpe_32k.model")).count() == 0
    assert sum(r.sample == 1 for r in sampling.segmentations(df, tokens.path("piece_bpe_32k.model")).collect()) == len(ODD)
    scored = ngrams.scores(df).collect()
    assert sorted(r.n_words for r in scored) == [0, 0, 2, 2, 4, 3000] and all((r.mean_log is None) == (r.n_words == 0) for r in scored)
    assert ngrams.scores(df.limit(0)).count() == 0


def test_codes_round_trip_and_random_access():
    rng = random.Random(2)
    for _ in range(60):
        docs = [(rng.choice([None, rng.randrange(-5, 10**12)]), np.array([rng.randrange(1 << rng.randrange(1, 33)) for _ in range(rng.randrange(1500))], np.uint32)) for _ in range(rng.randrange(4))]
        s = dac.Segment(dac.encode(docs))
        flat = np.concatenate([x for _, x in docs]) if docs else np.empty(0, np.uint32)
        assert (s.ids() == flat).all() and s.documents == [d for d, _ in docs]
        assert all(s.id(i) == flat[i] for i in rng.sample(range(len(flat)), min(30, len(flat))))
    with pytest.raises(ValueError):
        dac.Segment(b"nope" + bytes(20))


def test_codes_query_equals_brute_force(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(dac, "SEGMENT_IDS", 3000)
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    rows, ids, at = {r.doc_id: r for r in Q.op10_token_codes(spark, DATA).collect()}, library("word_bpe_49k.json"), 0
    for d, text in docs:
        want = np.concatenate([ids(text), np.array([1], "<u4")])
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    flat = np.concatenate([np.concatenate([ids(text), np.array([1], "<u4")]) for _, text in docs])
    dac.write(spark.read.parquet(f"{DATA}/documents.parquet"), tokens.path("word_bpe_49k.json"), f"{tmp_path}/all")
    asked = [0, len(flat) - 1, len(flat), -1, 5, 5, *random.Random(1).sample(range(len(flat)), 400)]
    found = {r.place: r.id for r in dac.lookup(spark, f"{tmp_path}/all", spark.createDataFrame([(x,) for x in [*asked, None]], "place long")).collect()}
    assert found == {x: flat[x] for x in asked if 0 <= x < len(flat)}
    odd = spark.createDataFrame(ODD, SCHEMA)
    dac.write(odd, tokens.path("word_bpe_49k.json"), f"{tmp_path}/codes")
    got = sorted((r.start, r.doc_id) for r in dac.read(spark, f"{tmp_path}/codes").collect())
    assert [d for _, d in got] == [None, 1, 2, 2, 3, 9]
    dac.write(odd.limit(0), tokens.path("word_bpe_49k.json"), f"{tmp_path}/none")
    assert dac.read(spark, f"{tmp_path}/none").count() == 0


def all_segmentations(v, word):
    word, place, logs = sampling.SPACE + word, {p: i for i, p in enumerate(v.pieces)}, dict(zip(v.ids.tolist(), v.logs, strict=True))
    out = {}

    def go(i, ids, log):
        if i == len(word):
            out[tuple(ids)] = log
        for j in range(i + 1, len(word) + 1):
            if place.get(word[i:j]) in logs:
                go(j, [*ids, place[word[i:j]]], log + logs[place[word[i:j]]])

    go(0, [], 0.0)
    total = np.logaddexp.reduce(list(out.values()))
    return {k: x - total for k, x in out.items()}


def test_samples_are_distinct_right_and_without_replacement():
    v = sampling.vocabulary(tokens.path("piece_bpe_32k.model"))
    first, second = all_segmentations(v, "the"), all_segmentations(v, "ab")
    exact = {(*a, *b): x + y for a, x in first.items() for b, y in second.items()}
    n = 20_000
    found = sampling.sample(list(range(n)), ["the ab"] * n, v, 2)
    pairs = collections.Counter(tuple(tuple(s[0].tolist()) for s in r) for r in found)
    want = {(a, b): math.exp(x + y) / (1 - math.exp(x)) for a, x in exact.items() for b, y in exact.items() if a != b}
    assert sum(abs(pairs[k] / n - p) for k, p in want.items()) / 2 < 0.01
    assert all(abs(log - exact[tuple(ids.tolist())]) < 1e-9 for r in found[:200] for ids, log, _ in r)
    mean = np.mean([sum(math.exp(log) / q * len(ids) for ids, log, q in r) for r in found])
    assert abs(mean - sum(math.exp(x) * len(k) for k, x in exact.items())) < 0.02
    every = sampling.sample([1, 2], ["ab", "ab"], v, 50)
    assert all(len(r) == len(second) and {q for *_, q in r} == {1.0} for r in every)


def test_samples_decode_and_depend_on_the_key_only():
    v = sampling.vocabulary(tokens.path("piece_bpe_32k.model"))
    texts = ["", "  a  b ", "a\nb\tc", "日本 ☃ ①", "x" * 400, None, "plain words and more"]
    found = sampling.sample(list(range(len(texts))), texts, v, 3)
    for text, samples in zip(texts, found, strict=True):
        assert len({ids.tobytes() for ids, *_ in samples}) == len(samples) >= 1
        assert all(v.decode(ids.tolist()) == (text or "") for ids, *_ in samples)
    alone = sampling.sample([6], texts[6:], v, 3)[0]
    assert all((a[0] == b[0]).all() for a, b in zip(alone, found[6], strict=True))


def log_mass(v, place, logs, word):
    """The logarithm of the weights of all segmentations of a word, by a plain sum over its ends."""
    word = sampling.SPACE + word
    mass = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        ways = [mass[i] + logs[place[word[i:j]]] for i in range(max(0, j - v.longest), j) if place.get(word[i:j]) in logs]
        if place.get(word[j - 1]) not in logs:
            ways.append(mass[j - 1] + v.byte_log * len(word[j - 1].encode()))
        mass[j] = float(np.logaddexp.reduce(ways))
    return mass[-1]


def test_sampling_query_equals_brute_force(spark):
    """Distinct samples of every text that decode to it, each with the log-probability of its pieces."""
    file = tokens.path("piece_bpe_32k.model")
    v, docs = sampling.vocabulary(file), spark.read.parquet(f"{DATA}/documents.parquet")
    place, logs = {p: i for i, p in enumerate(v.pieces)}, dict(zip(v.ids.tolist(), v.logs.tolist(), strict=True))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = Q.op6_sampled_segmentations(spark, DATA).collect()
    with_ids = {(r.doc_id, r.sample): r.ids for r in sampling.segmentations(docs, file, with_ids=True).collect()}
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(with_ids)
    masses, single, own = {}, set(v.bytes), collections.defaultdict(set)
    for r in rows:
        ids, text = with_ids[r.doc_id, r.sample], texts[r.doc_id]
        assert r.n_pieces == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and v.decode(ids) == text
        assert tuple(ids) not in own[r.doc_id] and 1 <= r.sample <= sampling.SAMPLES and 0 <= r.inclusion <= 1
        own[r.doc_id].add(tuple(ids))
        if "  " in text or text[:1] == " " or sampling.SPACE in text:
            continue
        words = text.split(" ") if text else []
        want = sum(v.byte_log if i in single else logs[i] for i in ids) - sum(masses.setdefault(w, None) or masses.update({w: log_mass(v, place, logs, w)}) or masses[w] for w in words)
        assert abs(r.log_prob - want) < 1e-6 * max(1, abs(want))


def test_long_unbroken_texts_are_sampled_fast_and_alike():
    import time

    v, rng = sampling.vocabulary(tokens.path("piece_bpe_32k.model")), random.Random(3)
    for letters in ("etaoinshrdlu", "".join(chr(0x4E00 + i) for i in range(3000))):
        text = "".join(rng.choice(letters) for _ in range(100_000))
        start = time.process_time()
        samples = sampling.sample([5], [text], v, 3)[0]
        assert time.process_time() - start < 6  # 1 to 2 s alone
        assert len({ids.tobytes() for ids, *_ in samples}) == len(samples) and all(v.decode(ids.tolist()) == text for ids, *_ in samples)
    words = ["".join(rng.choice("etaoinshé日") for _ in range(n)) for n in (193, 250, 400)]
    found = sampling.sample([1, 2, 3], words, v, 3)
    plain, sampling.LONG = sampling.LONG, 10**9
    try:
        want = sampling.sample([1, 2, 3], words, v, 3)
    finally:
        sampling.LONG = plain
    assert all((a[0] == b[0]).all() and abs(a[1] - b[1]) < 1e-9 for x, y in zip(found, want, strict=True) for a, b in zip(x, y, strict=True))


def test_words_with_equal_ends_share_their_lattice(monkeypatch):
    v = sampling.vocabulary(tokens.path("piece_bpe_32k.model"))
    words = ["meaning", "leaning", "ning", "\u65e5ning", "", "x" * 300]
    lattice = sampling.Lattice(words, v)
    # the ends of "meaning", the empty one too; then l, its mark, two other marks, a sign and its mark, the mark alone, and the long word
    assert len(lattice.first) - 1 == 9 + 2 + 1 + 2 + 1 + 301
    for word, start in zip(words, lattice.start.tolist(), strict=True):
        alone = sampling.Lattice([word], v)
        here, own = start, int(alone.start[0])
        while here or own:
            a, b = (slice(x.first[n], x.first[n + 1]) for x, n in ((lattice, here), (alone, own)))
            assert (lattice.piece[a] == alone.piece[b]).all() and (lattice.log[a] == alone.log[b]).all() and (lattice.total[a] == alone.total[b]).all()
            here, own = int(lattice.to[a][-1]), int(alone.to[b][-1])
    texts = [" ".join(random.Random(i).choices(words[:4], k=40)) for i in range(20)]
    together = sampling.sample(list(range(20)), texts, v)
    monkeypatch.setattr(sampling, "WALKED", 50)
    apart = sampling.sample(list(range(20)), texts, v)
    assert all((a[0] == b[0]).all() and a[1:] == b[1:] for x, y in zip(together, apart, strict=True) for a, b in zip(x, y, strict=True))


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "BUCKET_WORDS", 5000)
    monkeypatch.setattr(ngrams, "CHUNK_DOCS", 37)
    monkeypatch.setattr(ngrams, "JOIN_ROWS", 2)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    words = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    counts = collections.Counter(w for x in words.values() for w in x)
    total = sum(counts.values())
    for limit in (ngrams.VOCABULARY, 300):
        mine = {r.doc_id: r for r in ngrams.scores(docs, limit=limit).collect()}
        at = sorted(set(counts.values()), reverse=True)
        least = min(c for c in at if sum(n >= c for n in counts.values()) <= limit)
        known = lambda w, least=least: w if counts[w] >= least else None
        single = collections.Counter()
        for w, n in counts.items():
            single[known(w)] += n
        own = {d: collections.Counter(zip(map(known, x), map(known, x[1:]), strict=False)) for d, x in words.items()}
        pairs = sum(own.values(), collections.Counter())
        for d, x in words.items():
            y = list(map(known, x))
            want = math.log(single[y[0]] / total) if y else 0.0
            for p, q in zip(y, y[1:], strict=False):
                want += math.log(pairs[p, q] / single[p]) if pairs[p, q] > own[d][p, q] else math.log(0.4 * single[q] / total)
            assert mine[d].n_words == len(x) and abs(mine[d].log_score - want) < 1e-6 * max(1, abs(want))


@pytest.mark.parametrize("most", [300, 1])
def test_rare_words_have_their_own_counts(spark, monkeypatch, most):
    for name, value in (("VOCABULARY", most), ("BUCKET_WORDS", 5000), ("CHUNK_DOCS", 37), ("JOIN_ROWS", 2), ("ODD_PAIRS", 100)):
        monkeypatch.setattr(ngrams, name, value)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    texts |= {-1: "qx1 qx2 qx3", -2: "qx2 qx3 qx2 qx3", -3: "qx9", -4: "", -5: "the qx1 the qx1"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    words = {d: (t or "").encode().lower().split() for d, t in texts.items()}
    single = collections.Counter(w for x in words.values() for w in x)
    own = {d: collections.Counter(zip(x, x[1:], strict=False)) for d, x in words.items()}
    pairs, total = sum(own.values(), collections.Counter()), sum(single.values())
    mine = {r.doc_id: r for r in ngrams.scores(docs).collect()}
    assert len(mine) == len(texts) and len(single) > most
    for d, x in words.items():
        want = math.log(single[x[0]] / total) if x else 0.0
        for p, q in zip(x, x[1:], strict=False):
            want += math.log(pairs[p, q] / single[p]) if pairs[p, q] > own[d][p, q] else math.log(0.4 * single[q] / total)
        assert mine[d].n_words == len(x) and abs(mine[d].log_score - want) < 1e-6 * max(1, abs(want))


def brute_backoff(texts, order):
    """Scores word by word: the longest n-gram seen elsewhere, log 0.4 for each word left off."""
    words = [(t or "").encode().lower().split() for t in texts]
    own = [collections.Counter(tuple(x[i : i + n]) for n in range(1, order + 1) for i in range(len(x) - n + 1)) for x in words]
    counts, total = sum(own, collections.Counter()), sum(map(len, words))
    for x, mine in zip(words, own, strict=True):
        score = 0.0
        for i in range(len(x)):
            most = min(i + 1, order)
            for n in range(most, 0, -1):
                g = tuple(x[i - n + 1 : i + 1])
                if n == 1 or counts[g] > mine[g]:
                    score += math.log(counts[g] / (counts[g[:-1]] if n > 1 else total)) + (most - n) * math.log(0.4)
                    break
        yield len(x), score


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff_of_any_order_equals_brute_force(spark, order):
    rng = random.Random(order)
    texts = [" ".join(rng.choice("ab cd E f\tg\n h1 h2".split(" ")) for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += [None, "", " \n", "a", "a b", *texts[:9], *(f"n{i} n{i + 1} n{i} n{i + 1} x{i}" for i in range(300)), "x " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", F.lit("x"))
    found = {r.doc_id: r for r in backoff.backoff_scores(docs, order=order).collect()}
    for i, (n, want) in enumerate(brute_backoff(texts, order)):
        assert found[i].n_words == n and abs(found[i].log_score - want) < 1e-8 * max(1, abs(want)) and (found[i].mean_log is None) == (n == 0)
    assert len(found) == len(texts) and backoff.backoff_scores(docs.limit(0)).count() == 0


def test_score_query_equals_its_sql_and_the_joins(spark, duck, same_rows):
    rows = Q.op2_lm_scores(spark, DATA)
    same_rows(rows, duck.execute(Q.ORACLES["op2_lm_scores"]))
    joined = {r.doc_id: r for r in backoff.backoff_scores(spark.read.parquet(f"{DATA}/documents.parquet"), order=2).collect()}
    assert all(joined[r.doc_id].n_words == r.n_words and abs(joined[r.doc_id].log_score - r.log_score) < 1e-5 + 1e-9 * abs(r.log_score) for r in rows.collect())


def test_more_words_than_are_numbered(spark):
    n, size = 54, 5000
    texts = [(d, " ".join(f"w{d}x{i}" for i in range(size))) for d in range(n)] + [(n, "w0x0 w0x1 w1x7")]
    assert n * size > ngrams.VOCABULARY
    mine = {r.doc_id: r.log_score for r in ngrams.scores(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    total = n * size + 3
    once, twice = math.log(0.4 / total), math.log(0.4 * 2 / total)
    assert abs(mine[5] - (math.log(1 / total) + (size - 1) * once)) < 1e-6 * size
    assert abs(mine[n] - (math.log(2 / total) + math.log(2 / 2) + twice)) < 1e-6


def test_arc_versions_and_faults():
    records = [("http://a b/\nc", "19990102030405", "text/html", b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"), ("http://x/", "20000101000000", "text/plain", b"\n\nraw\n"), ("", "20000101000000", "text/html", b"")]
    for version in (1, 2):
        raw = warc.build_arc(version, "n.arc", records)
        got = list(warc.parse_arc(raw))
        assert [(r.fields["URL"], r.fields["Archive-date"], r.fields["Content-type"], r.block) for r in got] == [("http://a b/%0Ac", *records[0][1:]), ("http://x/", *records[1][1:]), ("about:blank", *records[2][1:])]
        assert got[0].payload_at == len(records[0][3]) - 2 and got[1].payload_at == 0
        with pytest.raises(ValueError):
            list(warc.parse_arc(raw[:-1] if records[-1][3] else raw[: raw.rindex(b"raw")]))
        text = warc.to_warc(got[0], "n.arc", "d" * 64, None).decode()
        assert "WARC-Date: 1999-01-02T03:04:05Z" in text and "WARC-Type: response" in text and text.endswith("hi\r\n\r\n")
        target = {"page": 7, "record": "<urn:uuid:1>", "date": "1998-01-01T00:00:00Z", "url": "http://x/"}
        text = warc.to_warc(got[0], "n.arc", "d" * 64, target).decode()
        assert text.endswith("Content-Length: 2\r\n\r\n\r\n\r\n") and "WARC-Refers-To: <urn:uuid:1>\r\nWARC-Refers-To-Target-URI: http://x/\r\nWARC-Refers-To-Date: 1998-01-01T00:00:00Z" in text
        assert len({r.identifier(n) for r in got for n in ("n.arc", "m.arc")}) == 6
    with pytest.raises(ValueError):
        list(warc.parse_arc(raw.replace(b"2 0 tapeloom", b"9 0 tapeloom")))


def test_archives_of_odd_pages(spark, tmp_path):
    same = "x" * 120
    rows = [(5, "http://a/", same, 1), (3, None, same, 1), (3, None, same, 1), (9, "u v\nw", same, 2), (4, "http://b/", None, 3), (6, "http://b/", "", 3), (7, "http://b/", "short", 3), (8, "http://b/", "short", 3), (None, "http://n/", same, 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive int")
    warc.archive(pages.repartition(3), f"{tmp_path}/a")
    warc.convert(spark.read.parquet(f"{tmp_path}/a"), f"{tmp_path}/w")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(spark, f"{tmp_path}/w").collect()), key=repr)
    assert got == sorted([(5, 120, "revisit", 3), (3, 120, "response", None), (3, 120, "response", None), (9, 120, "revisit", 3), (4, 0, "response", None), (6, 0, "response", None), (7, 5, "response", None), (8, 5, "response", None), (None, 120, "response", None)], key=repr)
    assert len({r.record_id for r in warc.read(spark, f"{tmp_path}/w").collect()}) == len(rows)
    import gzip

    whole = b"".join(gzip.decompress(r.archive) for r in spark.read.parquet(f"{tmp_path}/w").collect())  # archives are gzip files
    assert whole.count(b"WARC/1.1\r\n") == len(rows) and whole.count(b"WARC-Refers-To: <urn:uuid:") == 2
    warc.archive(pages.limit(0), f"{tmp_path}/none")
    warc.convert(spark.read.parquet(f"{tmp_path}/none"), f"{tmp_path}/nothing")
    assert warc.read(spark, f"{tmp_path}/nothing").count() == 0


def test_faulty_archives_are_rows(spark, tmp_path):
    records = [("http://a/", "19990102030405", "text/html", b"first" * 30), ("http://b/", "19990102030406", "text/html", b"second" * 30)]
    whole = warc.build_arc(1, "w.arc", records)
    cases = {"whole": whole, "cut": whole[:-5], "version": whole.replace(b"1 0 tapeloom", b"9 0 tapeloom"), "date": whole.replace(b"19990102030406", b"19991302030406"), "long": warc.build_arc(2, "l.arc", [("http://l/", "19990102030405", "text/html", b"x" * 20_000_000)]), "empty": b"", "none": None}
    archives = spark.createDataFrame([(k, v and bytearray(v)) for k, v in cases.items()], "name string, arc binary")
    found = {r.name: r.fault for r in warc.faults(archives).collect()}
    assert set(found) == {"cut", "version", "date", "empty", "none"} and "cut off" in found["cut"]
    warc.convert(archives, f"{tmp_path}/w")
    read = warc.read(spark, f"{tmp_path}/w").collect()
    assert sorted(r.payload_bytes for r in read) == [150, 150, 150, 180, 20_000_000]


def test_archive_query_equals_its_sql(spark, duck, same_rows):
    same_rows(Q.op5_warc(spark, DATA), duck.execute(Q.ORACLES["op5_warc"]))


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline as P

    from tapeloom.llm import langid, pii, quality

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    one = P.quality_rules(spark, docs, DATA)
    crf = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in docs.collect() if quality.judge(r.text, crf)["kept"]}
    two = P.language_id(spark, one, DATA)
    known = langid.Compressors(langid.learn(one.filter(~Q.held_out())))
    assert {r.doc_id for r in two.collect()} == {r.doc_id for r in one.collect() if known.predict(r.text)[3]}
    three = P.minhash_dedup(spark, two, DATA).collect()
    from test_duplicates import brute

    _, parts = brute({r.doc_id: r.text for r in two.collect()}, 5, 80)
    assert {r.doc_id for r in three} == set(parts.values())
    four = P.pii_masking(spark, spark.createDataFrame(three, docs.schema), DATA)
    assert four.columns == docs.columns
    texts = {r.doc_id: r.text for r in four.collect()}
    assert texts == {r.doc_id: pii.redact(r.text, pii.spans(r.text)) for r in three}
    check_packed(P.run(spark, DATA).collect(), texts, library("byte_bpe_50k.json"), 0)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, repeated rows and ids, clashing names and empty tables pass through all stages."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("row", F.lit(7)).withColumn("quality", F.lit("x")).withColumn("tokens", F.lit(None).cast("string"))
    good = docs.join(spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1").select("doc_id"), "doc_id", "left_semi").filter("length(text) > 300").orderBy("doc_id").limit(12)
    twice = good.limit(4)
    odd = good.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    same_id = good.filter("doc_id % 2 = 0").withColumn("doc_id", F.lit(-5).cast("long"))
    nulls = good.limit(5).select(*(F.lit(None).cast(t).alias(c) for c, t in good.dtypes))
    table = docs.unionByName(twice).unionByName(odd).unionByName(same_id).unionByName(nulls)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = P.minhash_dedup(spark, table.filter("text is not null"), str(tmp_path))
    assert kept.columns == table.columns
    from test_duplicates import brute

    texts = [r.text for r in table.filter("text is not null").select("text").collect()]
    _, parts = brute(dict(enumerate(texts)), 5, 80)
    groups = collections.Counter(t for t in set(parts.values()))
    assert kept.count() == len(groups)  # one row of each group, whatever the ids
    rows = P.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in rows) > 0 and max(r.sequence_id for r in rows) == (sum(r.length for r in rows) - 1) // packing.LENGTH
    table.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0


def test_columns_with_the_names_of_inner_ones(spark, tmp_path):
    """Operators read their own columns only, so others may have the names that they use inside."""
    from tapeloom.llm import embeddings, minhash

    names = "id key band digest queue part at n ids row window size first cell side marks deals component words total weight label2 bucket number base".split()
    texts = ["one two three four five six", "one two three four five six", "other words that stand alone", None]
    docs = spark.createDataFrame([(i, t, "s", *["x"] * len(names)) for i, t in enumerate(texts)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, width=3).collect()) == [(0, 0), (1, 0), (2, 2), (3, 3)]
    assert sum(r.length for r in packing.pack(docs, tokens.path("byte_bpe_50k.json")).collect()) > 20
    assert len(ngrams.scores(docs).collect()) == len(backoff.backoff_scores(docs).collect()) == 4
    assert len({r.doc_id for r in sampling.segmentations(docs, tokens.path("piece_bpe_32k.model")).collect()}) == 4
    dac.write(docs, tokens.path("word_bpe_49k.json"), f"{tmp_path}/codes")
    assert dac.read(spark, f"{tmp_path}/codes").count() == 4
    vectors = docs.withColumn("vec_id", F.col("doc_id")).withColumn("label", F.lit(1)).withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    assert {(r.n_links, r.component_id) for r in embeddings.near_duplicates(vectors).collect()} == {(3, 0)}
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x/").alias("url"), F.col("text").alias("html"), *names, F.lit("y").alias("page"), F.lit("z").alias("name"), F.lit("w").alias("arc"))
    warc.archive(pages, f"{tmp_path}/arc")
    assert spark.read.parquet(f"{tmp_path}/arc").count() > 0


def test_exploded_pairs_leave_a_worker_in_small_batches(monkeypatch):
    """A worker once held the rows of all buckets, and their Arrow copies, before the first went out."""
    import types

    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(ngrams, "OUT_PAIRS", 100, raising=False)
    texts = [" ".join(f"w{i * j % 97}" for j in range(40)) for i in range(50)]
    hashes = np.sort(np.array([ngrams.word_hash(f"w{i}".encode()) for i in range(97)], np.int64))
    shared = types.SimpleNamespace(value=(hashes, np.ones(98, np.int64), 2000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([t.encode() for t in texts])], ["key", "text"])
    out = list(ngrams._explode(shared, 40, 1, False)(iter([batch])))
    assert len(out) > 5 and max(b.num_rows for b in out) < 40
    times = sum(int(ngrams.unplanes(x.as_py(), "<u4").sum()) for b in out for k, x in zip(b.column(1).to_pylist(), b.column(6), strict=True) if k >= 0)
    assert times == 50 * 39


def test_words_are_encoded_once_in_a_worker():
    """A task forgets its pieces, but not the words, which its worker's next task would encode again."""
    e = tokens.Encoder(tokens.path("byte_bpe_50k.json"))
    texts = [f"alpha{'abcdefghij'[i % 10]} beta gamma" for i in range(50)]
    first, asked, encode = e.encode(texts), [], e._encode_words
    e.forget()
    e._encode_words = lambda words, lead: asked.extend(words.to_pylist()) or encode(words, lead)
    assert e.encode(texts) == first and not asked
    assert all(not len(m.keys) for m in tokens.Encoder(tokens.path("byte_bpe_50k.json")).pieces.values())


def test_a_full_memo_keeps_its_first_quarter(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "MEMO", 8)
    memo, asked = tokens.Memo(), []

    def encode(new):
        asked.extend(new.to_pylist())
        return pa.array([p.encode() for p in new.to_pylist()], pa.large_binary())

    for k in range(0, 12, 4):
        memo.get(pa.array([f"p{k + i}" for i in range(4)], pa.large_string()), encode)
    asked.clear()
    got = memo.get(pa.array(["p1", "p11", "p0", "p5"], pa.large_string()), encode)
    assert got.to_pylist() == [b"p1", b"p11", b"p0", b"p5"] and asked == ["p11", "p5"]
