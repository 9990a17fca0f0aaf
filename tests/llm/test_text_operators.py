"""Quality rules, language ID and PII: brute force, edge cases, held-out accuracy."""

import hashlib
import random
import re
import zlib

import pytest
from conftest import DATA

from tapeloom.llm import langid, pii, quality
from tapeloom.llm import queries as Q

ODD = "doc_id long, text string, lang string, source string, n_chars long, quality string, PII string, language int"
ROWS = [(1, None, "en", None, None, "x", None, 1), (2, "", None, "s", 0, None, None, None), (3, "a b " * 30_000, "en", "s", 1, None, None, None), (4, "same text here", "en", "s", 1, None, None, 2), (4, "same text here", "en", "s", 1, None, None, 2), (None, "\n\n \t\n", "de", "s", 1, None, None, None)]


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(marked), "base_failed": len(words) < 20 or 100 * len(marked) > 30 * len(words)}


def test_quality_figures_equal_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b ", "a b c d e f g h ", "\n", "|", "é ", "\x0b"]) for _ in range(rng.randrange(60)))
        got = quality.judge(text, quality.LineCrf())
        assert {k: got[k] for k in brute_quality(text)} == brute_quality(text)


def test_viterbi_finds_the_best_sequence():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    crf = quality.LineCrf(rng.normal(size=(quality.N_FEATURES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    lines = [quality.line_features(b"Some words | here!!" * (i + 1), 3, i % 2 == 0) for i in range(6)]

    def score(y):
        total = crf.start[y[0]] + sum(crf.emit[f, y[i]] for i, x in enumerate(lines) for f in x)
        return total + sum(crf.step[a, b] for a, b in zip(y, y[1:], strict=False))

    assert crf.viterbi(lines) == list(max(itertools.product((0, 1), repeat=6), key=score))


def test_equal_scores_put_content_last():
    crf = quality.LineCrf()
    assert crf.viterbi([[0]] * 5) == [0] * 5
    crf.step[:] = [[0, 1], [1, 0]]  # it pays to change: two sequences are equally good
    assert crf.viterbi([[0]] * 4) == [1, 0, 1, 0]


def best_path(crf, lines):
    """The best state sequence by its score, of all of them line by line; ties by the sequence itself."""
    best = {y: (crf.start[y] + sum(crf.emit[f, y] for f in lines[0]), (y,)) for y in (0, 1)}
    for x in lines[1:]:
        best = {y: max(((s + crf.step[z, y] + sum(crf.emit[f, y] for f in x), (*path, y)) for z, (s, path) in best.items()), key=lambda c: c[0]) for y in (0, 1)}
    return max(best.values(), key=lambda c: c[0])[1]


MORE = DATA.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def half(spark):
    """A labeller fitted on half of the labelled documents, and the other half's (doc_id, text, quality)."""
    docs, labels = spark.read.parquet(f"{MORE}/documents.parquet"), spark.read.parquet(f"{MORE}/labels.parquet")
    crf = quality.fit(docs, labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 2 = 0"))
    return crf, docs.join(labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 2 = 1"), "doc_id").select("doc_id", "text", "quality").collect()


def test_quality_labels_are_told_apart_on_documents_not_fitted_on(half):
    crf, held = half
    found = [(quality.judge(r.text, crf), r.quality) for r in held]
    rows = [(f["kept"], q) for f, q in found if not f["base_failed"]]
    assert len(rows) > 100 and sum(kept == bool(q) for kept, q in rows) >= 0.97 * len(rows)


def test_lines_of_mixed_texts_are_told_apart(half):
    """Runs of lines of held-out good and bad documents: 9 of 10 lines get their kind, and shares lie between 0 and 1."""
    crf, held = half
    kinds = {q: [x for r in held if r.quality == q for x in (r.text or "").split("\n") if len(x.split()) > 4] for q in (0, 1)}
    rng, right, total = random.Random(2), 0, 0
    for _ in range(200):
        lines, states = [], []
        for k in rng.choice([(0, 1), (1, 0), (0, 1, 0), (1, 0, 1)]):
            n = rng.randrange(1, 5)
            lines += rng.choices(kinds[1 - k], k=n)
            states += [k] * n
        found = crf.viterbi([quality.line_features(*x) for x in quality.lines_of("\n".join(lines))])
        right, total = right + sum(a == b for a, b in zip(found, states, strict=True)), total + len(states)
    assert right >= 0.9 * total
    text = "\n".join([*kinds[1][:3], *kinds[0][:3]])
    assert 0 < quality.judge(text, crf)["content_share"] < 1
    assert sum(len(set(y)) > 1 for y, _ in quality.LineCrf.weak([(1 - r.quality, [quality.line_features(*x) for x in quality.lines_of(r.text or "")][:64]) for r in held if (r.text or "").strip()])) > 3


def test_quality_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    crf = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = Q.op1_quality_rules(spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        want, seen, lines = brute_quality(text), set(), []
        for line in text.split("\n"):
            if line.encode().split():
                lines.append((line.encode(), line in seen))
                seen.add(line)
        path = best_path(crf, [quality.line_features(x, len(x.split()), again) for x, again in lines]) if lines else ()
        content = sum(len(x.split()) for (x, _), y in zip(lines, path, strict=True) if y == 0)
        want |= {"n_lines": len(lines), "n_content_lines": path.count(0), "kept": not want["base_failed"] and content >= 0.5 * want["n_words"]}
        assert {k: r[k] for k in want} == want and (not want["n_words"] or abs(r.content_share - content / want["n_words"]) < 1e-12)


def test_odd_rows_pass_through_all_text_operators(spark):
    docs = spark.createDataFrame(ROWS, ODD)
    out, name = quality.annotate(docs, quality.LineCrf())
    rows = out.collect()
    assert name == "quality_" and len(rows) == len(ROWS)
    assert [r[name].n_words for r in rows] == [0, 0, 60_000, 3, 3, 0]
    assert not any(r[name].kept for r in rows)  # too short, or repeated
    crf = quality.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.annotate(docs.limit(0), crf)[0].count() == 0
    out, name = langid.annotate(docs, langid.learn(docs))
    assert name == "language_" and [r[name].lang_pred for r in out.collect()] == ["und", "und", "en", "en", "en", "und"]
    out, name = langid.annotate(docs, {})
    assert {r[name].lang_pred for r in out.collect()} == {"und"}
    out, name = pii.annotate(docs)
    assert name == "pii_" and [r[name] for r in out.collect()] == [[]] * 6
    assert pii.mask(docs).collect() == docs.collect()


def test_language_accuracy_on_held_out_rows(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = Q.op8_language_id(spark, DATA).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_query_equals_zstandard_text_by_text(spark):
    import regex
    import zstandard

    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("held_out", Q.held_out())
    known = langid.learn(docs.filter("not held_out"))
    assert set(known) == {r.lang for r in docs.filter("not held_out and lang is not null").select("lang").distinct().collect()}
    texts, rows = {r.doc_id: r.text for r in docs.collect()}, Q.op8_language_id(spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        plain = regex.sub(r"[^\p{L}]+", " ", (texts[r.doc_id] or "").lower()).strip().encode()
        if not plain:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        sizes = {}
        for name, raw in known.items():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[name] = sum(len(c.compress(plain[i : i + langid.BLOCK_BYTES])) for i in range(0, len(plain), langid.BLOCK_BYTES))
        best, next_best = sorted(sizes.values())[:2]
        assert sizes[r.lang_pred] == best and abs(r.margin - (next_best - best) / best) < 1e-12 and r.confident == (r.margin >= langid.MIN_MARGIN)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(text):
    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


@pytest.mark.parametrize("letters", ["a@.1+- (", "a.@-b@", "12.", "1234567890 -+()", "ab@.c+1 é"])
def test_base_spans_equal_the_patterns(letters):
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert [s for s in pii.spans(text) if s[0] in pii.BASE_KINDS] == brute_pii(text)


def test_added_spans_and_masking():
    text = 'token = "24be64439e3e49cf" and http://joe:hunter22@host.org account no. 12345678 iban DE89370400440532013000 or x@y.zz'
    assert {s[0] for s in pii.spans(text)} >= {"email", "secret", "account", "login"}
    masked = pii.redact(text, pii.spans(text))
    assert not any(x in masked for x in ("24be64439e3e49cf", "hunter22", "12345678", "DE8937", "x@y.zz"))
    assert pii.spans("account of the iban and token of the day") == []
    value = "24be64439e3e49cf"
    for cue, found in (("ToKeN", True), ("access_token", True), ("TOKEN", True), ("mytoken", False), ("Ɛtoken", False)):
        assert bool(pii.spans(f"İ {cue} = {value}")) == found, cue
    assert [s[0] for s in pii.spans("AcCount 12345678 subaccount 12345678")] == ["account"]


def test_pii_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in Q.op4_pii(spark, DATA).collect():
        found = brute_pii(texts[r.doc_id] or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in found) for k in pii.BASE_KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
