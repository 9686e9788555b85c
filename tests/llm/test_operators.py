"""Each operator against brute force, an exact round trip or its library, and on odd rows."""

import base64
import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from casewright.llm import exact_dedup, jaccard_join, line_dedup, lm_score, piece_codec, quality_model, quality_rules, source_mix, text_stats, token_counts, warc
from casewright.llm.bpe import piece_model, pre_tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string"


def documents(spark, texts, **_):
    return spark.createDataFrame([(i, t, "en" if i % 2 else "de", f"s{i % 3}") for i, t in enumerate(texts)], DOCS)


def invented(n, seed, words=40, vocabulary=300):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(names) for _ in range(rng.randint(1, words))) for _ in range(n)]


# 1


def test_warc_round_trip(spark, ws):
    html = ["<p>" + "é" * 90_000, "<p>" + "é" * 90_000, None, "", "x", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://x/{i}\n", h, 5) for i, h in enumerate(html)], "page_id long, url string, html string, size int")
    got = {r.page_id: r for r in warc.round_trip(pages, ws).collect()}
    for i, h in enumerate(html):
        body = (h or "").encode()
        same = max(j for j, x in enumerate(html) if (x or "") == (h or ""))
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if same == i else ("revisit", same))
    table = warc.read_warc(spark.read.parquet(f"{ws.path}/manifest"), chunk=1000).filter("page_id = 1").orderBy("chunk").collect()
    assert len(table) == 181 and b"".join(bytes(r.data) for r in table).decode() == html[1]
    running = hashlib.sha1(b"".join(bytes(r.data) for r in table[:7]))
    assert table[6].digest_so_far == base64.b32encode(running.digest()).decode() and [r["last"] for r in table].count(True) == 1


def test_warc_odd_rows(spark, ws):
    pages = spark.createDataFrame([(None, None, "a"), (1, None, "a"), (1, None, "a"), (None, None, None)], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.round_trip(pages, ws).collect())
    assert got == [("1", "response", None), ("1", "response", None), ("None", "response", None), ("None", "revisit", 1)]


def test_warc_empty_table(spark, ws):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"), ws).count() == 0


# 2 and 7

TEXTS = ["", " ", "  ", "a  b", " a ", "\n\n x\t", "▁a▁▁b", "日本語 テキスト 🎉🎉", "a" * 700, "<s> </s> <0x0A> <unk>", "     lots     of    spaces   ", "\x00\x01", "ab" * 400, "return" * 90, "the the\nthe", *invented(80, 1), *["".join(random.Random(k).choice("abcthereing \n.,é") for _ in range(150)) for k in range(150)]]


def test_tokens_are_the_librarys(spark):
    want = sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(TEXTS, num_threads=1)
    assert token_counts.count_tokens(TEXTS, MODEL).tolist() == [len(w) for w in want]
    flat, n = piece_codec.encode_texts(TEXTS, MODEL)
    at = np.cumsum([0, *n])
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want
    assert [t.decode() for t in piece_codec.transducer(MODEL).decode(flat, n)] == [t.replace("▁", " ") for t in TEXTS]


def test_merging_one_place_at_a_time_agrees():
    model = piece_model(MODEL)
    flat, _, n = model.symbols([" " + t for t in TEXTS])
    rows, again = np.arange(len(n)), []
    fast, k = model.merge(flat, n)
    out, done = model._run(flat, n, rows, True, again)
    sizes = dict(zip(np.concatenate([r for r, _ in done]).tolist(), np.concatenate([m for _, m in done]).tolist(), strict=True))
    assert [sizes[i] for i in range(len(n))] == k.tolist()


def test_token_and_codec_odd_rows(spark, odd):
    got = token_counts.token_counts(odd, MODEL).collect()
    assert len(got) == odd.count() and {(r.n_bytes, r.n_tokens) for r in got if r.doc_id == 0} == {(0, 0)}
    assert sum(r.over_limit for r in got) == sum(r.n_tokens > 4096 for r in got) > 0
    coded = piece_codec.encode(odd, MODEL)
    assert coded.filter("not round_trip").count() == 0 and coded.count() == odd.count()
    back = {(r.doc_id, r.text) for r in piece_codec.decode(coded.filter("doc_id is not null"), MODEL).collect()}
    assert back == {(r.doc_id, (r.text or "").replace("▁", " ")) for r in odd.filter("doc_id is not null").collect()}
    assert token_counts.token_counts(odd.limit(0), MODEL).count() == 0 and piece_codec.encode(odd.limit(0), MODEL).count() == 0


def test_pre_tokens_and_spelling_in_arrays(monkeypatch):
    texts = ["", " ", *(" " + t for t in TEXTS), " x \ud800 y", "no space first"]
    codes, lengths, words = piece_codec.coded_pre_tokens([t.encode("utf-8", "surrogatepass") for t in texts])
    assert [words[c] for c in codes] == [w for t in texts for w in pre_tokens(t)] and lengths.tolist() == [len(pre_tokens(t)) for t in texts]
    assert len(set(words)) == len(words) and piece_codec.coded_pre_tokens([b""])[1].tolist() == [0]
    machine, calls, plain = piece_codec.transducer(MODEL), [], piece_codec.Transducer._spelled
    monkeypatch.setattr(piece_codec.Transducer, "_spelled", lambda self, *a: (calls.append(1), plain(self, *a))[1])
    odd = [" 𝕏a", " \ud800", " b🎉🎉", " plain", " \u0e01x\u0e02"]
    got = [np.frombuffer(p, np.int32) for p in machine.encode_words(odd)]
    assert len(calls) == 1  # all words of a batch at once
    assert [machine.raw[np.concatenate([np.arange(machine.raw_starts[i], machine.raw_starts[i + 1]) for i in p])].tobytes() for p in got] == [w.encode("utf-8", "surrogatepass") for w in odd]


def test_long_stretches():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC0123456789+/") for _ in range(30_000)), "a" * 9_000, "日本語テキスト" * 1_500, "ab é" * 20 + "return" * 2_000]
    want = sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(texts, num_threads=1)
    assert token_counts.count_tokens(texts, MODEL).tolist() == [len(w) for w in want]
    flat, n = piece_codec.encode_texts(texts, MODEL)
    assert [p.tolist() for p in np.split(flat, np.cumsum(n)[:-1])] == want


def field(number, value):
    """A field of a protocol buffer: a number, or bytes with their length."""
    varint = lambda x: bytes([x & 127 | 128]) + varint(x >> 7) if x > 127 else bytes([x])
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def unigram_model(path, charsmap, squeeze):
    """A small unigram model with byte fallback, written by hand."""
    rng, kinds = random.Random(3), [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    words = {"▁", "▁a", "ab", "abc", "▁the", "he", "r", "é", "ein", "▁e", *"abcdefghinrt", *("".join(rng.choice("abcdehnrt") for _ in range(rng.randint(2, 4))) for _ in range(120))}
    kinds += [(w, -rng.uniform(2, 12), 1) for w in sorted(words)]
    pieces = b"".join(field(1, field(1, p.encode()) + b"\x15" + np.float32(score).tobytes() + field(3, kind)) for p, score, kind in kinds)
    path.write_bytes(pieces + field(2, field(3, 1) + field(35, 1)) + field(3, (field(2, charsmap) if charsmap else b"") + field(3, 1) + field(4, int(squeeze)) + field(5, 1)))
    return str(path)


@pytest.mark.parametrize("rules", [False, True])
def test_unigram_model_and_normaliser(tmp_path, rules):
    charsmap = b""
    if rules:
        from casewright.llm.bpe import _charsmap

        tsv = tmp_path / "rules.tsv"
        tsv.write_text("41\t61\n42\t62\nC4\t61 65\n65 301\tE9\n9\t20\nAD\t\n")
        proto = sentencepiece.SentencePieceNormalizer(rule_tsv=str(tsv)).serialized_model_proto()
        at = {}
        for number, value in plain_fields(proto):
            at[number] = value
        charsmap = dict(plain_fields(at[3]))[2]
        assert _charsmap(charsmap) == {"A": "a", "B": "b", "Ä": "ae", "e\u0301": "é", "\t": " ", "\xad": ""}
    path = unigram_model(tmp_path / "u.model", charsmap, rules)
    texts = [*TEXTS, "ABBA Ä e\u0301 x\t\ty\xad", "abcabcthehereinabc" * 200]
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    flat, n = piece_codec.encode_texts(texts, path)
    for text, got, want in zip(texts, np.split(flat, np.cumsum(n)[:-1]), library.encode(texts, num_threads=1), strict=True):
        if got.tolist() != want:  # paths of equal weight but for rounding
            assert sum(map(library.get_score, got.tolist())) == pytest.approx(sum(map(library.get_score, want)), rel=1e-5), text[:50]
    with pytest.raises(ValueError, match="merges"):
        token_counts.count_tokens(["a"], path)


def plain_fields(data):
    """Number and bytes of each field with a length."""
    i = 0
    while i < len(data):
        key, i = read_varint(data, i)
        size, i = read_varint(data, i) if key & 7 in (0, 2) else ({1: 8, 5: 4}[key & 7], i)
        if key & 7 == 2:
            yield key >> 3, data[i : i + size]
        i += 0 if key & 7 == 0 else size


def read_varint(data, i):
    value = shift = 0
    while True:
        value |= (data[i] & 127) << shift
        shift, i = shift + 7, i + 1
        if data[i - 1] < 128:
            return value, i


# 3


def plain_stats(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def test_text_counts():
    texts = ["", "a b c a b c", "a a a a", "a b c d", "x\nx\n \n\nx", "#<b>", "é ü\x85z", *invented(60, 2, 60, 9)]
    got = text_stats.measure(texts)
    for i, t in enumerate(texts):
        assert tuple(got.loc[i, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == plain_stats(t)


def test_exact_binomial_and_choice():
    assert quality_rules.at_most(2, 10, 0.3) == pytest.approx(sum(math.comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(3)))
    good, bad = np.array([0, 0, 300, 700]), np.array([5, 50, 5, 40])
    assert quality_rules.choose(good, bad, 0.01, 0.01) == 1  # the third step loses too many good documents
    assert quality_rules.choose(np.array([0, 0, 3]), np.array([2, 2, 2]), 0.01, 0.01) is None  # too few to certify anything
    assert quality_rules.choose(good, np.zeros(4, int), 0.01, 0.01) is None


def test_rules_hold_their_risk(spark, ws):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(3000):
        bad = i % 5 == 0
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randrange(10_000)) for _ in range(60)]
        rows.append((i, " ".join(w + "#" * 9 if bad else w for w in words), "en"))
        labels.append((i, 0 if bad else 1))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality_rules.apply_rules(docs, marks, ws, risk=0.02).collect()  # 1 % over seven rules would take 3,500 good labels
    lost = sum(not r.kept for r in got if r.doc_id % 5)
    assert lost <= 0.02 * 2400 and sum(r.kept for r in got if r.doc_id % 5 == 0) == 0


def test_rules_reject_at_the_production_risk(spark, ws):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randrange(10_000)) for _ in range(60)]
        rows.append((i, " ".join(w + "#" * 9 if bad else w for w in words), ("en", "en", "en", "de", "fr")[i // 5 % 5]))
        labels.append((i, 0 if bad else 1))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality_rules.apply_rules(docs, marks, ws).collect()
    assert sum(r.kept for r in got if r.doc_id % 5 == 0) == 0 and sum(not r.kept for r in got if r.doc_id % 5) <= 0.01 * 1200
    assert quality_rules.pools({"en": 1400, "de": 330, "fr": 340, "es": 210}, 0.01, 0.05) == {"es": 0, "de": 0, "fr": 0, "en": 1}
    assert quality_rules.pools({"en": 1400, "de": 30}, 0.01, 0.05) == {"de": 0, "en": 0}


def plain_verdicts(texts, langs, labels, risk, level):
    """Which documents the certified rules reject, step by step in plain Python."""
    counts = text_stats.measure(texts)
    share = lambda a, b: (counts[a] / counts[b].clip(lower=1)).tolist()
    falling, lengths = np.round(np.linspace(0.98, 0.02, 49), 4).tolist(), np.round(np.geomspace(60, 5, 40), 3).tolist()
    rules = {
        "symbols": (share("n_symbols", "word_chars"), falling), "dup_lines": (share("n_dup_lines", "n_lines"), falling), "repeats": (share("n_repeat_words", "n_words"), falling), "capitals": (share("n_upper", "word_chars"), falling),
        "digits": (share("n_digits", "word_chars"), falling), "long_words": (share("word_chars", "n_words"), lengths), "short_words": (share("n_words", "word_chars"), falling),
    }
    fold = {i: zlib.crc32(str(i).encode()) % 3 == 0 for i in labels}
    strata, n_good = sorted(set(langs[i] for i in labels)), Counter(langs[i] for i in labels if not fold[i] and labels[i] == 1)
    own_level = level / len(strata)
    need = math.ceil(math.log(own_level) / math.log1p(-risk))
    order = sorted(strata, key=lambda s: (n_good[s], s))
    few = sum(n_good[s] < need for s in order)
    while 0 < few < len(order) and sum(n_good[s] for s in order[:few]) < need:
        few += 1
    rejected = set()
    for members in [order[:few], *([s] for s in order[few:])]:
        of = lambda tuning, kind: [i for i in labels if langs[i] in members and fold[i] == tuning and (labels[i] == 1) == kind]  # noqa: B023, E731
        path = []
        for budget in quality_rules.BUDGETS:
            step = {}
            for name, (value, grid) in rules.items():
                best = None
                good, bad = of(True, True), of(True, False)
                for cut in grid:
                    lost, caught = sum(value[i] > cut for i in good), sum(value[i] > cut for i in bad)
                    if lost <= budget * max(1, len(good)) and caught * max(1, len(good)) > lost * len(bad) and (best is None or caught > best[0]):
                        best = (caught, cut)
                if best:
                    step[name] = best[1]
            if step and step not in path:
                path.append(step)
        chosen, most = None, -1
        good, bad = of(False, True), of(False, False)
        out = lambda i, step: any(rules[name][0][i] > cut for name, cut in step.items())  # noqa: B023, E731
        # a document is counted at the first step of the path that rejects it
        for k in range(len(path)):
            lost, caught = (sum(any(out(i, s) for s in path[: k + 1]) for i in some) for some in (good, bad))
            if sum(math.comb(len(good), j) * risk**j * (1 - risk) ** (len(good) - j) for j in range(lost + 1)) > own_level:
                break
            if bad and caught * len(good) > lost * len(bad) and caught > most:
                chosen, most = path[k], caught
        if chosen:
            rejected |= {i for i in range(len(texts)) if langs[i] in members and out(i, chosen)}
    return rejected


def test_verdicts_against_plain_rules(spark, ws):
    rng = random.Random(8)
    texts, langs, labels = [], [], {}
    for i in range(900):
        bad = rng.random() < 0.3
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(1000)) * (rng.random() < 0.5) for _ in range(60)]
        if bad or rng.random() < 0.004:
            words = [w + "#" * rng.randint(0, 6) if rng.random() < 0.7 else w.upper() for w in words]
        texts.append(" ".join(words))
        langs.append(("en", "en", "de", "fr")[i % 4])
        if i % 7:
            labels[i] = int(not bad)
    docs = spark.createDataFrame([(i, t, langs[i]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), ws, risk=0.06).collect()}
    want = plain_verdicts(texts, langs, labels, 0.06, 0.05)
    assert want and {i for i, r in got.items() if r.failed_rules} == want
    assert all(r.kept == (not r.base_failed and i not in want) for i, r in got.items())


def test_rules_odd_rows(spark, odd, ws):
    none = spark.createDataFrame([(None, None), (1, 1), (1, 0), (99, 1)], "doc_id long, quality int")
    got = quality_rules.apply_rules(odd, none, ws).collect()
    assert len(got) == odd.count() and all(r.base_failed and not r.kept for r in got if r.n_words < 50)


def test_rules_empty_table(spark, odd, ws):
    assert quality_rules.apply_rules(odd.limit(0), spark.createDataFrame([], "doc_id long, quality int"), ws).count() == 0


# 4


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, ws, weak):
    texts = ["a  b", "a b", "c", None, "", " ", "x" * 40, "x" * 41, "x" * 40 + " ", "ab" * 50, "ab" * 50, "ab" * 49 + "ba", *invented(40, 3, 6, 4)]
    how = {"fingerprint": lambda b: F.octet_length(b) % 2} if weak else {}
    got = {r.doc_id: r for r in exact_dedup.exact_groups(documents(spark, texts), ws, block_bytes=8, **how).collect()}
    body = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for i, b in enumerate(body):
        same = [j for j, x in enumerate(body) if x == b]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (same[0], len(same), i == same[0], hashlib.sha256(b.encode()).hexdigest())


def test_exact_odd_rows(spark, odd, ws):
    got = exact_dedup.exact_groups(odd, ws).collect()
    assert len(got) == odd.count() and sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert next(r for r in got if r.doc_id == 5).group_size == 5  # ids 4 and 5, two repeats, and one without id


def test_exact_stage_and_empty_table(spark, odd, ws):
    kept = exact_dedup.drop_copies(odd, ws)
    assert kept.columns == odd.columns and kept.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in odd.collect()})


def test_exact_empty_table(odd, ws):
    assert exact_dedup.exact_groups(odd.limit(0), ws).count() == 0


# 5


def test_lm_base_and_probabilities(spark, ws):
    texts = [*invented(120, 4), None, "", "A b", "zzz unseen"]
    got = {r.doc_id: r for r in lm_score.score(documents(spark, texts), ws).collect()}
    words = [[*(w.lower() for w in WORD.findall(t or "")), ""] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    c = Counter(w for i, ws_ in enumerate(words) if not held[i] for w in ws_)
    n, v = sum(c.values()), len(c)
    for i, row in enumerate(words):
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(row), sum(c[w] > 0 for w in row), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in row))
        assert got[i].score < 0


def lm_model(bodies):
    table, code = np.zeros(lm_score.LINES * 16, np.uint32), lm_score.Code(np.bincount(np.frombuffer(b"".join(bodies), np.uint8), minlength=256))
    lm_score.count_halves(bodies, table, code)
    return lm_score.Mixer(lm_score.log_odds(table), code)


def test_next_bytes_sum_to_one_at_most():
    bodies = [lm_score.body_of(t) for t in invented(40, 6, 60)]
    model = lm_model(bodies)
    lm_score.learn(model, np.zeros(model.weights.shape), np.zeros((2, lm_score.GATES * lm_score.BUCKETS)), bodies, [[] for _ in bodies])
    for start in (b"", b"ab", bodies[0][:20]):
        whole = lm_score.log2_texts(model, [start, *(start + bytes([c]) for c in range(256))], [[(0, b"abc")]] * 257)
        assert 0.97 < sum(2.0 ** (whole[1:] - whole[0])) < 1.001  # 30 of the codes of three halves stand for no byte


def plain_halves(training):
    """The half bytes of each byte, by its place among all by frequency."""
    counts = Counter(c for text in training for c in text)
    out = {}
    for r, c in enumerate(sorted(range(256), key=lambda c: (-counts[c], c))):
        out[c] = (r,) if r < 14 else (14, r - 14) if r < 30 else (15, (r - 30) // 16, (r - 30) % 16)
    return out


def plain_log2(training, body, expected):
    """A text's bits one by one, with dictionaries for tables; the starting weights."""
    lines, code = {}, plain_halves(training)

    def keys(text, i):
        before = (b"\n" * 8 + text)[: i + 8]
        word = re.search(rb"[^ \n]*$", before).group()
        rest = before[: len(before) - len(word) - 1]
        return [(k, before[-k:]) for k in (1, 2, 3, 4)] + [("w", word), ("p", re.search(rb"[^ \n]*$", rest).group(), word)]

    for text in training:
        for i, c in enumerate(text):
            for key in keys(text, i):
                for j, half in enumerate(code[c]):
                    lines.setdefault((key, code[c][:j]), Counter())[half] += 1
    total, alive = 0.0, True
    for i, c in enumerate(body):
        want = code[expected[i]] if alive and i < len(expected) else None
        for j, half in enumerate(code[c]):
            for bit in range(4):
                one = half >> (3 - bit) & 1
                z = 0.0
                for key in keys(body, i):
                    counts = lines.get((key, code[c][:j]), {})
                    n = [sum(v for h, v in counts.items() if h >> (4 - bit) == half >> (4 - bit) and (h >> (3 - bit) & 1) == side) for side in (0, 1)]
                    z += 0.3 / 16 * max(-127, min(127, round(16 * math.log((n[1] + 0.4) / (n[0] + 0.4)))))
                if want is not None and want[:j] == code[c][:j] and want[j] >> (4 - bit) == half >> (4 - bit):
                    z += math.log(i + lm_score.REACH + 1.5) * (1 if want[j] >> (3 - bit) & 1 else -1)
                total += math.log2(1 / (1 + math.exp(-z if one else z)))
        alive = alive and i < len(expected) and expected[i] == c
    return total


def test_scores_against_plain_bits():
    bodies = [lm_score.body_of(t) for t in ("the cat sat on the mat", "The dog sat on a log é", "")]
    model = lm_model(bodies)
    for body in (b"the dog sat on the cat\n", b"zzz\n", b"\n", bodies[1]):
        assert lm_score.log2_texts(model, [body], [[]])[0] == pytest.approx(plain_log2(bodies, body, b""), rel=5e-3)
        assert lm_score.log2_texts(model, [body], [[(0, b"the dog was")]])[0] == pytest.approx(plain_log2(bodies, body, b"the dog was"), rel=5e-3)


def test_stretches_do_not_depend_on_neighbours():
    bodies = [lm_score.body_of(t) for t in invented(60, 16, 400)] + [lm_score.body_of("w " * 3000)]
    model = lm_model(bodies[:30])
    together = lm_score.log2_texts(model, bodies, [[] for _ in bodies])
    assert together == pytest.approx([lm_score.log2_texts(model, [b], [[]])[0] for b in bodies], rel=1e-4)


def test_stretches_of_many_texts_go_together():
    bodies = [lm_score.body_of(t) for t in invented(16, 8, 400)]
    bodies = [(b * 20)[:3000] for b in bodies]
    model = lm_model(bodies)

    def calls(some):
        n = 0

        def count(frame, event, arg):
            nonlocal n
            n += event == "c_call"

        lm_score.log2_texts(model, some, [[] for _ in some])  # what is worked out once for the model
        sys.setprofile(count)
        try:
            lm_score.log2_texts(model, some, [[] for _ in some])
        finally:
            sys.setprofile(None)
        return n

    assert calls(bodies) < 3 * calls(bodies[:1])  # a stretch of all texts at a time, not text by text


def test_large_weights_are_clipped():
    bodies = [lm_score.body_of(t) for t in invented(20, 8, 400)]
    model = lm_model(bodies)
    model.weights[:, :, : lm_score.K] = 4
    assert model.cells()[1] > lm_score.WIDE // 2
    assert lm_score.log2_texts(model, [b"x\n"], [[]])[0] >= 4 * 4 * math.log2(1e-6)
    together = lm_score.log2_texts(model, bodies, [[] for _ in bodies])
    assert np.isfinite(together).all() and together == pytest.approx([lm_score.log2_texts(model, [b], [[]])[0] for b in bodies], rel=1e-3)


def test_lm_words_stay_arrays():
    words = [b"", "é".encode(), b"a", b"the"]
    got, counts = lm_score.unpacked(*lm_score.packed(words, np.array([3, 0, 2**40, 1])))
    assert got.to_pylist() == words and got.type == "large_binary" and counts.tolist() == [3, 0, 2**40, 1]
    assert lm_score.unpacked(*lm_score.packed([b""], np.array([5])))[0].to_pylist() == [b""]


def test_lm_expected_leaves_out_the_only_occurrence():
    body = lm_score.body_of(invented(1, 9, 4000)[0] * 3)
    _, at, n, ctx = lm_score.Stream([body]).anchors()
    order = np.argsort(ctx, kind="stable")
    first = order[np.r_[True, np.diff(ctx[order]) != 0]]
    segs = np.array([body[a : a + k] for a, k in zip(at[first].tolist(), n[first].tolist(), strict=True)], object)
    once, twice = (lm_score.Memory(ctx[first], segs, np.full(len(first), times)) for times in (1, 2))
    seg = dict(zip(ctx[first].tolist(), segs, strict=True))
    whole = [(a, seg[c][:k]) for a, k, c in zip(at.tolist(), n.tolist(), ctx.tolist(), strict=True)]
    other = [(a, s) for (a, s), k in zip(whole, n.tolist(), strict=True) if body[a : a + k] != seg[ctx[at.tolist().index(a)]]]
    assert whole and lm_score._expected([body], np.array([True]), once) == [whole]
    assert lm_score._expected([body], np.array([False]), twice) == [whole] and lm_score._expected([body], np.array([False]), once) == [other]
    none = lm_score.Memory(ctx[:0], segs[:0], n[:0])
    assert lm_score._expected([body, b"\n"], np.array([True, False]), none) == [[], []]


def test_lm_order_repeats_and_held_out_texts(spark, ws):
    rng = random.Random(4)
    texts = invented(260, 13, 120)
    held = [i for i in range(260) if zlib.crc32(str(i).encode()) % 5 == 1]
    taught = [i for i in range(260) if zlib.crc32(str(i).encode()) % 5 > 1]
    a, b = (max(x, key=lambda i: len(texts[i])) for x in (held, taught))
    words = texts[b].split()
    texts[a] = texts[b]
    c = next(i for i in held if i != a)
    texts[c] = " ".join(rng.sample(words, len(words)))
    got = {r.doc_id: r for r in lm_score.score(documents(spark, texts), ws).collect()}
    assert got[a].base_score == pytest.approx(got[c].base_score) and got[a].score > 0.7 * got[c].score  # order counts, and a known text is expected
    assert got[a].bits_per_byte < 0.6 * got[c].bits_per_byte
    rest = [got[i] for i in held if i not in (a, c)]
    assert sum(r.score for r in rest) > sum(r.base_score for r in rest) - 0.1 * sum(r.n_tokens for r in rest)


def test_lm_odd_rows(spark, odd, ws):
    got = lm_score.score(odd, ws).collect()
    assert len(got) == odd.count() and {r.n_tokens for r in got if r.doc_id == 0} == {1}


def test_lm_long_words_have_no_floor(spark, ws):
    rng = random.Random(3)
    held = [i for i in range(100, 130) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    texts = invented(100, 4) + [""] * 30
    for i, size in zip(held, (1_000, 30_000), strict=True):
        texts[i] = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(size))
    got = {r.doc_id: r for r in lm_score.score(documents(spark, texts), ws).collect()}
    assert got[held[0]].score < -700 and got[held[1]].score < -20_000 and got[held[1]].bits_per_byte > 2


def test_lm_words_without_objects():
    bodies = [lm_score.body_of(t) for t in ("", "a", "the  the\na", None, "é " * 50, *invented(30, 21))]
    words, many = lm_score.words_of(bodies)
    assert words.to_pylist() == [w for b in bodies for w in b.split()] and many.tolist() == [len(b.split()) for b in bodies]
    assert lm_score.words_of([b"\n"])[1].tolist() == [0]


def test_lm_continuations_travel_once(spark):
    docs = spark.createDataFrame([(i // 20, i % 5 == 1, lm_score.body_of(t)) for i, t in enumerate(invented(60, 5, 200))], "chunk long, held_out boolean, body binary")
    memory = lm_score._memory(docs)
    plan = memory._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") <= 3  # expected bytes, and what chunks ask for: counted, then joined
    seen, texts = Counter(), [(r.chunk, r.held_out, bytes(r.body)) for r in docs.collect()]
    for _, held, body in texts:
        for _, at, n, ctx in zip(*(x.tolist() for x in lm_score.Stream([body]).anchors()), strict=True):
            seen[ctx, body[at : at + n]] += not held
    for r in memory.filter("n is not null").collect():
        assert (r.n, bytes(r.seg)) == max((n, s) for (c, s), n in seen.items() if c == r.ctx)


def test_lm_empty_table(odd, ws):
    assert lm_score.score(odd.limit(0), ws).count() == 0


# 6


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, left = {s: weights[i % len(weights)] for i, s in enumerate(names)}, share * sum(sizes.values())
    target, open_ = {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix_meets_its_targets(spark, ws):
    docs = documents(spark, invented(400, 7)).withColumn("source", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("source")))
    got = source_mix.mix(docs, ws).collect()
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)


def test_mix_reruns_agree_and_whole_documents(spark, ws, odd):
    docs = documents(spark, invented(100, 8))
    a = source_mix.mix(docs, ws, whole=True, buckets=4).collect()
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in a)
    ws.drop()
    assert sorted(a) == sorted(source_mix.mix(docs.repartition(5), ws, whole=True, buckets=64).collect())
    ws.drop()
    assert source_mix.mix(odd, ws).count() == odd.count()
    ws.drop()
    assert source_mix.mix(odd.limit(0), ws).count() == 0
    ws.drop()
    assert source_mix.mixed_documents(docs, ws).columns == docs.columns


# 8


def test_repeated_lines_keep_the_first(spark, ws):
    passage = " ".join(f"w{i}" for i in range(60))
    texts = ["one\n" + passage, passage.upper() + "\nlast", "short line\nshort line", passage + "\n" + passage, None, ""]
    got = {r.doc_id: r for r in line_dedup.repeated_units(documents(spark, texts), ws).collect()}
    size = len(passage)
    assert [[(s.start, s.end, s.first_doc_id) for s in got[i].removed] for i in range(6)] == [[], [(0, size, 0)], [], [(0, size, 0), (size + 1, 2 * size + 1, 0)], [], []]
    ws.drop()
    cleaned = {r.doc_id: r.text for r in line_dedup.without_repeats(documents(spark, texts), ws).collect()}
    assert cleaned == {0: texts[0], 1: "last", 2: texts[2], 3: "", 4: None, 5: ""}


def test_passages_inside_lines_and_short_lines(spark, ws):
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [f"a b c {passage} d e f\nshort", f"other words then {passage} and more\nmore\nshort\nw1 w2", f"kept {passage}. {passage}."]
    got = {r.doc_id: r for r in line_dedup.repeated_units(documents(spark, texts), ws, min_words=1).collect()}
    left = []
    for i, t in enumerate(texts):
        for s in reversed(got[i].removed):
            t = t[: s.start] + t[s.end :]
        left.append(t)
    assert left[0] == texts[0] and len(left[1].split()) < 35 and "more\nmore" in left[1] and "short" not in left[1] and left[1].endswith("w1 w2")
    assert {s.first_doc_id for s in got[1].removed} == {0}
    assert len(left[2].split()) < 50
    ws.drop()
    cleaned = {r.doc_id: r.text for r in line_dedup.without_repeats(documents(spark, texts), ws, min_words=1).collect()}
    assert cleaned[0] == texts[0] and cleaned[1].split() == left[1].split() and cleaned[1].count("\n") == 2


def plain_spans(texts, min_words=1):
    """What of each text is removed: (start, end, first document), unit by unit in plain Python."""
    first, every = {}, []
    for i, t in enumerate(texts):
        units = line_dedup.units(t or "", False, min_words)
        every.append(units)
        for k, u in enumerate(units):
            first.setdefault(u[2:4], (i, k))
    out = []
    for i, units in enumerate(every):
        again, spans = [first[u[2:4]] != (i, k) for k, u in enumerate(units)], []
        for line in sorted({u[5] for u in units}):
            here = [k for k, u in enumerate(units) if u[5] == line]
            run = []
            for k in [*here, None]:
                if k is not None and again[k]:
                    run.append(k)
                    continue
                if run and (run == here or sum(units[j][4] for j in run) >= line_dedup.RUN_WORDS):
                    for j in run:
                        of = first[units[j][2:4]][0]
                        if j != run[0] and spans[-1][2] == of:
                            spans[-1] = (spans[-1][0], units[j][1], of)
                        else:
                            spans.append((units[j][0], units[j][1], of))
                run = []
        out.append(spans)
    return out


def test_pieces_cover_their_lines():
    rng = random.Random(14)
    for _ in range(200):
        text = "".join(rng.choice(["a", "bb ", "c. ", "\n", " ", "d! ", "é\t", "e"]) for _ in range(rng.randint(0, 120)))
        units = line_dedup.units(text, False, 1)
        for line in {u[5] for u in units}:
            own = [u for u in units if u[5] == line]
            assert text[own[0][0] : own[-1][1]] == text.split("\n")[line] and all(b[0] == a[1] + 1 for a, b in zip(own, own[1:], strict=False))
            assert [len(WORD.findall(text[u[0] : u[1]])) for u in own] == [u[4] for u in own]


def test_repeats_against_plain_grouping(spark, ws):
    rng = random.Random(15)
    passages = invented(8, 16, 60, 400)
    texts = []
    for _ in range(80):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(invented(1, rng.random(), 30, 400)) for _ in range(rng.randint(1, 4))]
        texts.append(rng.choice(["\n", ". ", " "]).join(parts))
    texts += ["", None, texts[0], "short", "short\nshort"]
    got = {r.doc_id: r for r in line_dedup.repeated_units(documents(spark, texts), ws, min_words=1).collect()}
    want = plain_spans(texts)
    assert [[(s.start, s.end, s.first_doc_id) for s in got[i].removed] for i in range(len(texts))] == want and sum(map(len, want)) > 50
    assert [got[i].n_words for i in range(len(texts))] == [len(WORD.findall(t or "")) for t in texts]
    assert [got[i].removed_words for i in range(len(texts))] == [sum(len(WORD.findall((texts[i] or "")[a:b])) for a, b, _ in want[i]) for i in range(len(texts))]


def test_lines_odd_rows_and_paragraphs(spark, odd, ws):
    assert line_dedup.repeated_units(odd, ws, min_words=1).count() == odd.count()
    assert [u[:2] for u in line_dedup.units("a b\nc\n \nd e f", True, 1)] == [(0, 5), (8, 13)]
    ws.drop()
    assert line_dedup.repeated_units(odd.limit(0), ws).count() == 0


# 9


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.random((4000, 3))] * 5)[:, :15]
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.fit(x, y, rounds=10)
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.97 and model.pairs
    assert quality_model.fit(x[:0], y[:0]).score(x).tolist() == [0.5] * len(x)


def test_classifier_on_held_out_rows(spark):
    good = invented(300, 9, 80)
    texts = [t if i % 3 else re.sub(r"(\w+)", r"\1$$$", t) for i, t in enumerate(good)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = quality_model.score_quality(documents(spark, texts), labels).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.95 * len(held)


def test_scores_against_plain_tables(spark):
    import bisect

    texts = [t if i % 3 else t.upper() + " #1" * (i % 5) for i, t in enumerate(invented(240, 17, 60))] + ["", None]
    labels = {i: int(i % 3 > 0) for i in range(240) if i % 4}
    got = {r.doc_id: r for r in quality_model.score_quality(documents(spark, texts), spark.createDataFrame([(i, q, 0) for i, q in labels.items()], LABELS)).collect()}
    x = quality_model.features(text_stats.measure([t or "" for t in texts]))
    taught = sorted(i for i in labels if zlib.crc32(str(i).encode()) % 5)
    model = quality_model.fit(x[taught], np.array([labels[i] for i in taught], float))
    for i, row in enumerate(x.tolist()):
        raw = model.base + sum(float(t[bisect.bisect_right(e.tolist(), v)]) for e, t, v in zip(model.edges, model.tables, row, strict=True))
        raw += sum(float(t[bisect.bisect_right(model.coarse[a].tolist(), row[a]), bisect.bisect_right(model.coarse[b].tolist(), row[b])]) for (a, b), t in zip(model.pairs, model.pair_tables, strict=True))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, raw)))), abs=1e-9) and got[i].predicted == int(got[i].score >= 0.3)


def test_classifier_odd_rows(spark, odd):
    none = spark.createDataFrame([(None, 1), (1, None), (2, 0), (2, 1)], "doc_id long, quality int")
    got = quality_model.score_quality(odd, none).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    empty = quality_model.score_quality(odd, none.limit(0)).collect()
    assert {r.score for r in empty} == {0.5} and quality_model.score_quality(odd.limit(0), none).count() == 0


# 10


def plain_components(texts, words, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def edited(text, rng, rate):
    return " ".join("".join(rng.choice("xyz") for _ in range(5)) if rng.random() < rate else w for w in text.split())


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_near_components(spark, ws, words, percent):
    rng = random.Random(words)
    texts = invented(60, 10, 12, 12) + [None, "", " ", "a", "A", "a b"]
    for base in invented(6, 11, 400, 2000):
        chain = base
        for k in range(12):
            texts.append(edited(base, rng, rng.choice([0, 0.005, 0.01, 0.02, 0.04])))
            chain = edited(chain, rng, 0.01)
            texts += [chain, chain.upper()] if k % 3 == 0 else [chain]
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_components(documents(spark, texts), ws, words, percent).collect()}
    assert got == plain_components(texts, words, percent)


def test_sketch_bounds_the_difference():
    rng, sizes = np.random.default_rng(3), jaccard_join.Sizes(80)
    for n in (1, 2, 5, 9, 16, 40, 300):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        for gone in range(0, n // 8 + 1):
            b = np.concatenate([a[gone:], rng.integers(0, 2**63, gone).astype(np.uint64)])
            flat, count = np.concatenate([np.unique(a), np.unique(b)]), np.array([len(np.unique(a)), len(np.unique(b))])
            _, _, keys, maps = jaccard_join.sketches(flat, count, sizes, 0)
            x, y = (np.frombuffer(m, np.uint8) for m in maps)
            assert int(np.bitwise_count(x ^ y).sum()) <= 2 * gone
            common = len(set(a.tolist()) & set(b.tolist()))
            if 100 * common >= 80 * (2 * n - common):
                assert set(keys[0].tolist()) & set(keys[1].tolist())


def test_large_groups_are_compared_in_blocks(spark, ws, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng, base = random.Random(2), invented(1, 12, 400, 2000)[0] * 3
    texts = [edited(base, rng, rng.choice([0.01, 0.03, 0.05])) for _ in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_components(documents(spark, texts), ws, 4, 85).collect()}
    assert got == plain_components(texts, 4, 85)


def test_near_keys_go_in_parts_and_sketches_are_dropped(spark, ws, monkeypatch):
    monkeypatch.setattr(jaccard_join, "ONE_PART", 0)
    rng, base = random.Random(3), invented(1, 13, 400, 2000)[0] * 3
    texts = [edited(base, rng, 0.02) for _ in range(12)] + invented(8, 14, 50, 200)
    kept, drops = [], []
    keep, drop = ws.keep, ws.drop
    ws.keep = lambda df, name: (kept.append(name), keep(df, name))[1]
    ws.drop = lambda name=None: (drops.append(name), drop(name))[1]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_components(documents(spark, texts), ws, 4, 85).collect()}
    assert got == plain_components(texts, 4, 85)
    assert "rows0" in drops and sum(name.startswith("shared/") for name in kept) > 1


def test_near_odd_rows(spark, odd, ws):
    got = jaccard_join.near_components(odd, ws).collect()
    assert len(got) == odd.count() and {(r.n_shingles, r.component_id) for r in got if r.doc_id == 0} == {(0, 0)}


def test_near_empty_table(odd, ws):
    assert jaccard_join.near_components(odd.limit(0), ws).count() == 0


# all


BIG = 2**60 + 1
NAMES = ("_id", "_k", "_sha", "_m", "_key", "_removed", "_times", "_row", "_turn", "_label", "row", "node", "done", "size", "bucket", "key", "removed")


@pytest.fixture(scope="module")
def clashing(spark):
    """Ids beyond 2^53 beside a null one, and columns with the names that operators use for themselves."""
    texts = [" ".join(f"w{i}" for i in range(60)), "other text here", None]
    rows = [(None, texts[0], "en", "s"), (BIG, texts[0], "en", "s"), (BIG + 2, texts[1], "de", "t"), (BIG + 4, texts[2], None, None)]
    return spark.createDataFrame([(*r, *["x"] * len(NAMES)) for r in rows], DOCS + "".join(f", {c} string" for c in NAMES))


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("n", range(1, 11))
def test_large_ids_beside_nulls_and_clashing_names(spark, clashing, ws, n):
    labels = spark.createDataFrame([(BIG, 1, 0), (BIG + 2, 0, 0)], LABELS)
    if n == 1:
        got = warc.round_trip(clashing.withColumnsRenamed({"doc_id": "page_id", "text": "html"}), ws).withColumnRenamed("page_id", "doc_id")
    else:
        got = {
            2: lambda: token_counts.token_counts(clashing, MODEL), 3: lambda: quality_rules.apply_rules(clashing, labels, ws), 4: lambda: exact_dedup.exact_groups(clashing, ws), 5: lambda: lm_score.score(clashing, ws), 6: lambda: source_mix.mix(clashing, ws),
            7: lambda: piece_codec.encode(clashing, MODEL), 8: lambda: line_dedup.repeated_units(clashing, ws), 9: lambda: quality_model.score_quality(clashing, labels), 10: lambda: jaccard_join.near_components(clashing, ws),
        }[n]()
    rows = got.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(["None", str(BIG), str(BIG + 2), str(BIG + 4)])
    if n == 1:
        assert {(r.doc_id, r.refers_to) for r in rows if r.record_type == "revisit"} == {(None, BIG)}
    if n == 4:
        assert {(r.doc_id, r.keep_id) for r in rows} == {(None, BIG), (BIG, BIG), (BIG + 2, BIG + 2), (BIG + 4, BIG + 4)}
    if n == 8:
        assert [[s.first_doc_id for s in r.removed] for r in rows if r.doc_id is None] == [[BIG]]
    if n == 10:
        assert {r.component_id for r in rows} == {BIG, BIG + 2, BIG + 4}


def test_stages_keep_clashing_columns(spark, clashing, ws):
    before = {tuple(r) for r in clashing.collect()}
    kept = [tuple(r) for r in exact_dedup.drop_copies(clashing, ws).collect()]
    assert len(kept) == 3 and set(kept) <= before
    ws.drop()
    near = [tuple(r) for r in jaccard_join.one_of_each(clashing, ws).collect()]
    assert len(near) == 4 and set(near) <= before
    ws.drop()
    mixed = [tuple(r) for r in source_mix.mixed_documents(clashing.unionByName(clashing), ws).collect()]
    assert set(mixed) <= before and mixed
    ws.drop()
    lines = line_dedup.without_repeats(clashing.unionByName(clashing), ws)
    assert lines.columns == [*clashing.columns, "removed_"]
    texts = sorted(r.text or "" for r in lines.filter("lang = 'en'").collect())
    assert texts[:3] == [""] * 3 and texts[3].startswith("w0")  # the first of four copies stays
