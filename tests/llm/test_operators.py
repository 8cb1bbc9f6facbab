"""Each operator against a brute-force version on small fixtures, with the odd cases: nulls, empty
and long texts, ties and repeated rows, empty tables, clashing extra columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from terraflux.llm import decontaminate, line_dedup, lm_scoring, pii, quality, sentencepiece_codec, simhash, token_counts, toxicity, url_filter
from terraflux.llm.common import bucket_of, connected_components, texts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, train boolean, __hash string, fp int"
WORDS = "of the and thion er onble shand ering to a in re that was Éa für niño".split()


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "x", "y", "z", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    base = [prose(rnd, rnd.randint(1, 120)) for _ in range(40)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(50, base[3]), (51, base[3]), (52, base[4] + " tail"), (3, base[3])]  # copies, a repeated row
    out += [(60, None), (61, ""), (62, "  \t\n "), (63, "one"), (None, base[5]), (None, None), (64, "w" * 50_000), (65, prose(rnd, 20_000)), (66, "日本語 テキスト 😀"), (67, base[6] + "\n" + base[6] + "\n" + base[6])]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, ["en", "de", None][k % 3], None if k % 5 == 0 else "s", 1, bool(k % 4), "clash", 7) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def split(t: str | None) -> list[bytes]:
    return (t or "").encode().lower().split()


# 1


def test_lm_scoring_base_is_exact(spark, docs):
    plain = [(r.doc_id, r.text, r.train) for r in docs.collect()]
    count: Counter = Counter()
    for _, t, train in plain:
        if train:
            count.update([*split(t), b"\n"])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t, train in plain:
        w = [*split(t), b"\n"]
        want[i, train, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 4)] += 1
    for frequent in (1 << 18, 5, 0):  # by the table of frequent words, by the join, by both
        got = lm_scoring.score(docs.withColumn("text", F.coalesce("text", F.lit(""))), filter_bits=1 << 20, frequent=frequent).collect()
        assert Counter((r.doc_id, r.train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_lm_words_and_hashes(monkeypatch):
    rnd, known = random.Random(1), {}
    for k in range(300):
        monkeypatch.setattr(lm_scoring, "HASHED_BYTES", (1, 7, 1 << 20)[k % 3])
        some = ["".join(rnd.choice("aB cé\n\t\x0b\x85\x1c d") for _ in range(rnd.randint(0, 40))).encode() for _ in range(rnd.randint(1, 6))]
        w = lm_scoring.Words(some)
        assert [w.buffer[a:b] for a, b in zip(w.starts, w.ends)] == [x for t in some for x in t.lower().split()]
        flat = [x for t in some for x in [*t.lower().split(), b"\n"]]
        h, first = w.with_ends()
        assert h.tolist() == lm_scoring.hashes_of(flat).tolist() and all(known.setdefault(x, y) == y for x, y in zip(flat, h.tolist()))
        assert [flat[i - 1] for i in first[1:].tolist()] == [b"\n"] * (len(some) - 1)
    words = [f"{a}{b}{i}".encode() for a in "abcdefgh" for b in "xyzä" for i in range(3000)]
    assert len(set(lm_scoring.hashes_of(words).tolist()) | set(known.values())) == len(set(words) | set(known))


def test_lm_filter_levels(spark):
    h = lm_scoring.mix(np.arange(5000, dtype=np.uint64))
    c = np.arange(1, 5001)
    q = lm_scoring.levels_of(c, 1.5)
    assert q[0] == 1 and q[1] == 2 and (np.diff(q) >= 0).all()
    bits = np.zeros(1 << 20, bool)
    for level in range(1, int(q.max()) + 1):
        a, b = lm_scoring.bit_key(h[q >= level], level)
        for i in range(4):
            bits[lm_scoring.bit_position(a, b, i, 1 << 20)] = True
    reader = lm_scoring.FrequencyFilter(np.packbits(bits, bitorder="little").tobytes(), 1, 1 << 20, 4)
    assert (reader.levels(h) >= q).all() and (reader.levels(h) == q).mean() > 0.97  # never missed, seldom too high
    assert (reader.levels(lm_scoring.mix(np.arange(10**6, 10**6 + 5000, dtype=np.uint64))) > 0).mean() < 0.05


def test_lm_scoring_holds_every_pair(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts_ = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(200)]
    ones, pairs = Counter(), Counter()
    for t in texts_:
        w = [*split(t), b"\n"]
        ones.update(w)
        pairs.update(zip([b"\n", *w], w))
    level = lambda c: 1 + math.floor(math.log(c) / math.log(1.5) + 1e-9)
    mean = []
    for count in (ones, pairs):
        by = defaultdict(list)
        for c in count.values():
            by[level(c)].append(c)
        mean.append({q: sum(c) / len(c) for q, c in by.items()})
    c1 = {w: mean[0][level(c)] for w, c in ones.items()}
    n = sum(ones.values()) + len(ones) + 1

    def want(t):
        w = [*split(t), b"\n"]
        return sum(math.log10(0.2 * min(1, mean[1][level(pairs[v, x])] / c1[v]) + 0.8 * (c1[x] + 1) / n) for v, x in zip([b"\n", *w], w))

    d = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts_)], "doc_id long, text string, train boolean")
    few, many = ({r.doc_id: r.score for r in lm_scoring.score(d, filter_bits=1 << k).collect()} for k in (26, 12))
    assert few == many  # the size of a block changes nothing
    assert all(many[i] >= want(t) - 2 and abs(many[i] - want(t)) < 0.1 * 61 for i, t in enumerate(texts_))
    assert sum(abs(many[i] - want(t)) for i, t in enumerate(texts_)) / 200 / 61 < 0.02


def test_lm_scoring_without_rows_or_training(spark, none, docs):
    assert lm_scoring.score(none).count() == 0
    got = lm_scoring.score(docs.where("doc_id < 5").withColumn("train", F.lit(False)), filter_bits=1 << 16).collect()
    assert got and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in got)


# 2


@pytest.fixture(scope="module")
def items():
    rnd = random.Random(9)
    return [" ".join(f"{rnd.choice(WORDS)}{rnd.choice('abcdefgh')}" for _ in range(rnd.randint(9, 50))) for _ in range(30)]


def test_decontamination_recall_and_precision(spark, items):
    rnd = random.Random(4)
    rows, planted = [], set()
    for i in range(120):
        k = i % 30
        w = items[k].split()
        for _ in range(decontaminate.allowed(len(w)) * (i % 4) // 3):
            at, what = rnd.randrange(max(1, len(w))), rnd.randrange(3)
            w[at : at + (what > 0)] = [] if what == 1 else [f"q{rnd.randrange(99)}"]
        rows.append((i, prose(rnd, 30) + " " + re.sub("[a-z]", lambda m: m[0].upper(), " ".join(w)) + " " + prose(rnd, 30)))
        planted.add((i, k))
    rows += [(1000 + i, prose(rnd, 300)) for i in range(40)] + [(None, None), (2000, ""), (2001, items[0]), (2001, items[0])]
    bench = spark.createDataFrame([(k, t, 5) for k, t in enumerate(items)] + [(90, None, 5), (91, "the of", 5), (92, items[2], 5)], "item_id long, text string, doc_id int")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.contamination(d, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert len(planted & pairs) >= 0.95 * len(planted)
    exact = {p for p in planted if p[0] % 4 == 0}
    assert exact <= pairs and {(i, 92) for i, k in exact if k == 2} <= pairs
    for r in got:  # every pair is verified
        w = np.array([hash(x) for x in split(items[r.item_id % 90]) if True]) if r.item_id < 30 else None
        if w is not None:
            text = next(t for i, t in rows if i == r.doc_id)
            best = decontaminate.passage_distance(w, np.array([hash(x) for x in split(text)]))[0]
            assert best <= r.distance <= decontaminate.allowed(len(w))
    assert sum(r.doc_id == 2001 and r.item_id == 0 for r in got) == 2  # repeated rows
    assert {r.doc_id for r in got if r.item_id == 91} == {i for i, t in rows if b" the of " in b" " + b" ".join(split(t)) + b" "}  # short items as they are
    kept = decontaminate.contaminated(d.withColumn("__found", F.lit(True)).withColumn("found", F.lit(True)), bench, False).collect()
    assert {r.doc_id for r in kept} == {i for i, _ in rows} - {p[0] for p in pairs}
    blocks = decontaminate.contamination(d, bench, block=7)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} >= exact
    assert decontaminate.contaminated(d, bench, True, block_words=100).count() >= len(exact)
    assert decontaminate.contamination(d, bench.where("item_id = 91")).count() == sum(r.item_id == 91 for r in got)
    assert decontaminate.contamination(d, bench.limit(0)).count() == 0 and decontaminate.contamination(d.limit(0), bench).count() == 0


def test_decontamination_samples_hold_for_every_length():
    rnd = random.Random(12)
    sizes = [5] * 6 + [10] * 30 + [24] * 30 + [60] * 6
    items = [([k], [f"w{rnd.randrange(3000)}".encode() for _ in range(n)]) for k, n in enumerate(sizes)]
    index, rng = decontaminate.Index(items, most_samples=2), np.random.default_rng(5)
    assert index.walks > 4  # there are more where the first do not reach the target
    for n in (5, 10, 24, 60):
        some = [x for x in index.items if len(x) == n]
        for x in some:
            assert decontaminate.passage_distance(x, index._edited(rng, x))[0] == decontaminate.allowed(n)
        found = 0
        names = {i: w for w, i in index.vocabulary.items()}
        for k in range(60):
            y = [names.get(i, b"?") for i in index._edited(rng, some[k % len(some)]).tolist()]
            found += any(index.items[i] is some[k % len(some)] for i, _, _ in index.search([[b"a"] * 5 + y + [b"b"] * 70])[0])
        assert found >= 60 * 0.85, (n, found)
    with pytest.raises(ValueError):
        decontaminate.Index(items, sample=60, recall=1.0, most_samples=2)


# 3


def naive_spans(x: str) -> list:
    out = []
    forms = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, form in enumerate(forms):
        for m in re.finditer(form, x):
            digits = re.sub("[^0-9]", "", m.group())
            if k == 1 and any(int(p) > 255 for p in m.group().split(".")) or k == 2 and not (16 <= len(digits) <= 19 and pii.luhn(digits)) or k == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((k, *m.span()))
    return out


def test_pii_patterns_match_the_plain_ones():
    rnd = random.Random(1)
    for _ in range(4000):
        x = "".join(rnd.choice("a1.@-+ (2)4 .@..1") for _ in range(rnd.randint(0, 60)))
        assert pii.pattern_spans(x) == naive_spans(x)
    assert pii.pattern_spans("1" * 100_000 + "@" + "." * 100_000) == []


def test_pii_repeats_become_consistent():
    x = "Call +1 (644) 555-7859 or 555-7859. Mail fbf.44@mail9.example.com, later fbf.44 again; 4532 0151 1283 0366 17 17 and plain 555-0000."
    more = pii.consistent_spans(x, pii.pattern_spans(x))
    assert {(pii.KINDS[k], x[a:b]) for k, a, b in more} == {("phone", "555-7859"), ("email", "fbf.44")}
    assert pii.consistent_spans("no data 1234567 here 1234567", []) == []


def test_pii_repeats_in_other_forms():
    forms = ["743-555-3824", "7435553824", "743.555.3824", "(743) 555-3824", "743 555 3824", "1-743-555-3824", "001 743 555 3824", "0743 5553824", "555-3824", "5553824"]
    for number in ("+1 (743) 555-3824", "+1-743-555-3824", "+17435553824"):
        for form in forms:
            for x in (f"Call {number}, or {form}. Not 743-555-3825, 3824 or 2024-01-15.", f"First {form} and 12 then {number}"):
                more = pii.consistent_spans(x, pii.pattern_spans(x))
                assert [(pii.KINDS[k], x[a:b]) for k, a, b in more] == [("phone", form)], (number, form, x)
    x = "Write to john.smith@x.org or <jsmith@x.org>, contact@x.org; John.Smith and jsmith, contact us, smithy."
    more = pii.consistent_spans(x, pii.pattern_spans(x))
    assert [(pii.KINDS[k], x[a:b]) for k, a, b in more] == [("email", "John.Smith"), ("email", "jsmith")]
    x = "4532 0151 1283 0366, again 4532.0151.1283.0366"
    assert [(k, x[a:b]) for k, a, b in pii.consistent_spans(x, pii.pattern_spans(x))] == [(2, "4532.0151.1283.0366")]
    x = "+1 743 555 3824 " * 3000 + "5553824 " * 3000  # linear
    assert len(pii.consistent_spans(x, pii.pattern_spans(x))) >= 1


def test_pii_message_passing_against_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    p = pii.Potentials(rounds=200)
    for edges in ([(0, 1), (1, 2), (1, 3)], [(0, 1), (1, 2), (2, 3), (3, 0)]):  # a tree, where it is exact, and a loop
        unary, weight = rng.normal(0, 1, (4, 3)), rng.uniform(0.1, 1.0, len(edges))
        exact = np.zeros((4, 3))
        for labels in itertools.product(range(3), repeat=4):
            mass = np.exp(sum(unary[i, x] for i, x in enumerate(labels)) + sum(w for (a, b), w in zip(edges, weight) if labels[a] == labels[b]))
            for i, x in enumerate(labels):
                exact[i, x] += mass
        exact /= exact.sum(1, keepdims=True)
        got = np.exp(pii.message_passing(unary, np.array(edges), weight, p))
        got /= got.sum(1, keepdims=True)
        assert np.abs(got - exact).max() < (1e-6 if len(edges) == 3 else 0.05)


def test_pii_rows(spark, docs, none, rows):
    got = pii.personal_data(docs)
    assert got.count() == len(rows) and pii.personal_data(none).count() == 0
    r = got.where("doc_id = 61").first()
    assert (r.n_email, r.spans, r.base_sha256) == (0, "", hashlib.sha256(b"").hexdigest())


# 4


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(8)
    bad = ["vileword", "nastyone", "awfulish"]

    def doc(y: int) -> str:
        w = prose(rnd, rnd.randint(5, 60)).split()
        for _ in range(y * rnd.randint(1, 3)):
            w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        return " ".join(w)

    train = [(doc(i % 2), i % 2) for i in range(500)]
    model = toxicity.fit(train)
    held = [(k, doc(k % 2)) for k in range(200)]
    typos = [(1000 + k, prose(rnd, 20) + " " + w) for k, w in enumerate(["vilewordd", "vilewword", "nastyonee", "nasstyone", "awfulishh"])]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(held + typos + [(5000, None), (5001, "")], "doc_id long, text string"), model).collect()}
    assert sum(got[k].predicted == k % 2 for k, _ in held) >= 0.95 * len(held)
    assert sum(got[k].predicted for k, _ in typos) >= 3
    assert 0 <= got[5000].score == got[5001].score < 0.7
    assert toxicity.fit([]).probability(np.zeros(1))[0] < 0.7 and toxicity.fit([("a", 1)]).probability(np.zeros(1))[0] > 0.7


def test_toxicity_sample_is_bounded_and_repeatable(spark):
    d = spark.createDataFrame([(i, f"text {i}") for i in range(100)] + [(5, "text 5")], "doc_id long, text string")
    y = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(3, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    a = toxicity.labelled_sample(d, y, per_class=20)
    assert len(a) == 40 and a == toxicity.labelled_sample(d.repartition(7), y.repartition(5), per_class=20)


def test_toxicity_sample_is_refilled_and_definite(spark):
    d = spark.createDataFrame([(i, ("long " * 9000 if i % 3 else "short ") + str(i)) for i in range(90)] + [(0, "other"), (0, "other")], "doc_id long, text string")
    y = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, toxic int")
    a = toxicity.labelled_sample(d, y, per_class=12)
    assert len(a) == 24 and all(len(t) < 20_000 for t, _ in a)  # long texts leave no gap
    assert {t for t, _ in toxicity.labelled_sample(d, y) if t in ("other", "short 0")} == {t for t, _ in toxicity.labelled_sample(d.repartition(5), y) if t in ("other", "short 0")}
    assert toxicity.labelled_sample(d.limit(0), y) == []


def test_toxicity_odd_rows(spark, docs, none, rows):
    model = toxicity.fit([("vileword " + prose(random.Random(i), 9), 1) if i % 2 else (prose(random.Random(i), 9), 0) for i in range(40)])
    got = toxicity.score(docs, model)
    assert got.count() == len(rows) and all(0 <= r.score <= 1 for r in got.collect()) and toxicity.score(none, model).count() == 0


# 5


def test_url_host_path_and_rule_in_sql(spark):
    import duckdb

    data = "/root/testdata/sf0.01"
    got = {(r.page_id, r.host, r.path, r.rule) for r in url_filter.judge(spark.read.parquet(f"{data}/pages.parquet")).collect()}
    fits = lambda host, path: f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"
    sql = f"""
      WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM '{data}/pages.parquet'),
      s AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM u),
      p AS (SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM s)
      SELECT page_id, host, path, CASE WHEN {fits('example.net', '/en/')} THEN 'example.net/en/' WHEN {fits('example.com', '/de/')} THEN 'example.com/de/' WHEN {fits('org', '/fr/')} THEN 'org/fr/' WHEN {fits('net', '/')} THEN 'net/' END FROM p"""
    assert got == set(duckdb.sql(sql).fetchall())


def test_url_labelled_table_decides_other_hosts(spark):
    rnd = random.Random(5)
    url = lambda bad: f"http://{rnd.choice(['casino', 'slots', 'betting'] if bad else ['library', 'museum', 'school'])}{rnd.randint(1, 999)}.{rnd.choice(['info', 'biz'])}/{'win' if bad else 'read'}/{rnd.randint(1, 99)}"
    labelled = spark.createDataFrame([(url(k % 2), bool(k % 2)) for k in range(120)], "url string, block boolean")
    pages = [(k, url(k % 2)) for k in range(200)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), labelled=labelled).collect()}
    assert all(r.rule is None for r in got.values()) and sum((got[k].verdict == "block") == bool(k % 2) for k, _ in pages) >= 195


def test_url_rules_and_verdicts(spark):
    urls = ["https://a.example.net/en/1", "http://example.net/de/1", "https://NET/x", "https://net", "https://m.example.com/de/2?x=/en/", "http://q.org/fr/", "http://borg/fr/", "no scheme", None, "", "x://example.org/fr", "https://fakenet/a", "a://b://c/d#e"]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string")).collect()}
    rules = [got[i].rule for i in range(len(urls))]
    assert rules == ["example.net/en/", "net/", "net/", None, "example.com/de/", "org/fr/", None, None, None, None, None, None, None]
    assert [got[i].verdict for i in (0, 1, 2, 4, 5)] == ["allow", "block", "block", "block", "allow"]
    assert (got[2].host, got[2].path, got[12].host, got[12].path) == ("net", "/x", "b:", "//c/d") and (got[8].host, got[7].host) == ("", "")
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_model_learns_and_stays_in_the_jvm(spark):
    rnd = random.Random(2)
    rows = [("".join(rnd.choice("abcdef") for _ in range(6)) + (".bad.test" if k % 2 else ".good.test"), f"/{rnd.randint(1, 999)}", bool(k % 2)) for k in range(400)]
    model = url_filter.fit(spark.createDataFrame(rows[:300], "host string, path string, block boolean"))
    held = spark.createDataFrame([(k, f"https://{h}{p}", b) for k, (h, p, b) in enumerate(rows[300:])], "page_id long, url string, block boolean")
    got = url_filter.judge(held, model, rules=())
    truth = {r.page_id: r.block for r in held.collect()}
    assert sum((r.verdict == "block") == truth[r.page_id] for r in got.collect()) >= 95
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().toString())


# 6


@pytest.fixture(scope="module")
def codec():
    from pathlib import Path

    return sentencepiece_codec.Codec.load(Path(sentencepiece_codec.default_model()).read_bytes())


def test_sentencepiece_equals_the_library(spark, docs, none, codec, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    rnd = random.Random(6)
    odd = ["", " ", "   ", " a", "a ", "  a  b", "\n\n", "▁", "▁▁a", "a▁b", "<s>", "<0x41>", "\x00", "x" * 3000, "ab " * 2000, "é", "ﬁ", "a\u3000b", "\u200b", "�"]
    odd += ["".join(rnd.choice(" ab\né▁😀\t<>s/") for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    for t in odd:
        got = codec.encode(t)
        assert [i for i, _, _ in got] == sp.encode(t)
        assert codec.decode([i for i, _, _ in got]) == sp.decode(sp.encode(t))
    full = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentencepiece_codec.digests(docs).collect()}
    want = set()
    for i, t in rows:
        ids = [1, *sp.encode(t or ""), 2]
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert full == want and sentencepiece_codec.digests(none).count() == 0
    some = sentencepiece_codec.encode(docs.where("doc_id = 66")).first()
    assert some.decoded == "日本語 テキスト 😀" and some.ends[-2] == len("日本語 テキスト 😀".encode())


def test_sentencepiece_digests_come_from_the_operator(spark, docs, codec, rows):
    assert "begins" in sentencepiece_codec.digests(docs)._jdf.queryExecution().toString()  # spans are made, as in the pipeline
    rnd = random.Random(7)
    more = [(1000 + k, "".join(rnd.choice(" ab\né▁😀\t<>s/\x00") for _ in range(rnd.randint(0, 60)))) for k in range(200)]
    d = spark.createDataFrame([*rows, *more], "doc_id long, text string")
    want = Counter()
    for i, t in [*rows, *more]:
        size = len((t or "").encode())
        got = [(codec.begin, 0, 0), *codec.encode(t or ""), (codec.end, size, size)]
        want[i, tuple(got), codec.decode([x[0] for x in got])] += 1
    assert Counter((r.doc_id, tuple(zip(r.ids, r.begins, r.ends)), r.decoded) for r in sentencepiece_codec.encode(d).collect()) == want


def test_sentencepiece_spans_cover_the_text(codec):
    for t in ("Hello there, wörld", " two  spaces", "日本語 😀"):
        data, at = t.encode(), 0
        for i, a, b in codec.encode(t):
            assert a == at or a == b
            at = max(at, b)
            if codec.kinds[i] == sentencepiece_codec.NORMAL and b > a:
                assert data[a:b].decode().strip() == codec.pieces[i].replace("▁", " ").strip()
        assert at == len(data)


def darts(keys: dict[bytes, bytes]) -> bytes:
    """A compiled character map by the simplest placement of a double array."""
    pool, value = b"", {}
    for k, to in sorted(keys.items()):
        value[k] = len(pool)
        pool += to + b"\0"
    units = {0: 0}
    children: dict[bytes, set[int]] = defaultdict(set)
    for k in keys:
        for i in range(len(k)):
            children[k[:i]].add(k[i])
    free = 256

    def place(prefix: bytes, at: int) -> None:
        nonlocal free
        base = free & ~0xFF
        free = base + 512
        offset = at ^ base
        units[at] = units.get(at, 0) | (offset << 10 if offset < 1 << 21 else (offset >> 8 << 10) | 1 << 9)
        if prefix in value:
            units[at] |= 1 << 8
            units[base] = value[prefix] | 1 << 31
        for c in sorted(children[prefix]):
            units[base ^ c] = c
        for c in sorted(children[prefix]):
            place(prefix + bytes([c]), base ^ c)

    place(b"", 0)
    n = max(units) + 1
    body = np.array([units.get(i, 0) for i in range(n)], "<u4").tobytes()
    return len(body).to_bytes(4, "little") + body + pool


def test_longest_prefix_normalisation_keeps_offsets(codec):
    from dataclasses import replace

    chars = sentencepiece_codec.CharacterMap(darts({"ﬁ".encode(): b"fi", b"a": b"A", b"ab": b"X", "\u3000".encode(): b" "}))
    c = replace(codec, chars=chars, squeeze=True)
    norm, origin = c.aligned("ﬁab\u3000ac ")
    assert norm == "▁fiX▁Ac" and origin == [0, 0, 0, 3, 5, 8, 9, 10]
    assert codec.aligned("a b")[1] == [0, 0, 1, 2, 3]


# 7


def test_token_counts_against_greedy(spark, docs, none, rows):
    rnd = random.Random(7)
    vocab = ["▁", "▁a", "▁ab", "▁abcd", "a", "b", "c", "bc", "bcda", "dab", "abcdab"]
    m = token_counts.LongestMatch(vocab)

    def greedy(w: str) -> int:
        i = n = 0
        while i < len(w):
            k = max((len(p) for p in vocab if w.startswith(p, i)), default=0)
            if not k:
                return -1
            i, n = i + k, n + 1
        return n

    for _ in range(5000):
        w = "▁" + "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 12)))
        assert m.count(w) == greedy(w), w
    got = {(r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in token_counts.token_counts(docs, vocabulary=vocab).collect()}
    want = set()
    for i, t in rows:
        k = [greedy("▁" + w.decode()) for w in (t or "").encode().split()]
        want.add((i, len(k), sum(x if x >= 0 else 1 for x in k), sum(x < 0 for x in k)))
    assert got == want and token_counts.token_counts(none, vocabulary=vocab).count() == 0
    assert m.count("▁" + "bcda" * 50_000) == 50_001


# 8


def counts_of(t: str | None) -> tuple:
    t = t or ""
    w = t.encode().split()
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(win)
    covered = {j for i, x in enumerate(win) if often[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_base(spark, docs, none, rows):
    got = quality.judge(docs, keep=["doc_id", "text"]).select("doc_id", "text", "quality.*").collect()
    assert len(got) == len(rows)
    for r in got:
        c = counts_of(r.text)
        assert c == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (c[0] < 20 or 100 * c[4] > 30 * c[0])
        assert not (r.base_failed and r.kept)
    assert quality.judge(none).count() == 0


def test_quality_outliers_by_group(spark):
    rnd = random.Random(12)
    rows = []
    for k in range(400):
        t = prose(rnd, rnd.randint(30, 300))
        if k % 20 == 0:
            t = " ".join(w + "***" for w in t.split())
        rows.append((k, t, "en", f"s{k % 2}"))
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).select("doc_id", "quality.kept").collect()}
    assert not any(got[k] for k in range(0, 400, 20)) and sum(not v for k, v in got.items() if k % 20) <= 2
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for n in (1, 10):  # a few rows alone say nothing about each other
        few = quality.judge(d.limit(n)).select("quality.*").collect()
        assert all(r.kept and r.distance < quality.CUTOFF for r in few if not r.base_failed)
    salted = quality.judge(d, few_groups=0)  # the same without broadcast
    plan = salted._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and not re.search("Python|Arrow|Pandas", plan)
    assert {r.doc_id: r.kept for r in salted.select("doc_id", "quality.kept").collect()} == got
    small = quality.judge(d.unionByName(d.where("doc_id in (1, 2, 20)").withColumn("source", F.lit("tiny")))).where("source = 'tiny'").select("doc_id", "quality.kept").collect()
    assert {r.doc_id: r.kept for r in small} == {1: True, 2: True, 20: False}  # judged by their language


def test_quality_passes_other_columns(spark):
    d = spark.createDataFrame([(1, "a b " * 40, None, "s", 5, "x", 7)], "doc_id long, text string, lang string, source string, quality int, `group` string, `a.b` int")
    got = quality.judge(d)
    assert got.columns == [*d.columns, "quality_"] and got.drop("quality_").collect() == d.collect()
    assert quality.judge(d.limit(0)).count() == 0


def chol(c: np.ndarray) -> list[float]:
    low = np.linalg.cholesky(c)
    return [low[i, j] for i in range(5) for j in range(i + 1)]


def test_quality_estimate_matches_numpy(spark):
    """Starts, one step and the leaning of one group against numpy; and what the steps lead to."""
    rng = np.random.default_rng(0)
    xs = quality.XS
    data = rng.normal(0, 1, (400, 5)) @ rng.normal(0, 1, (5, 5))
    data[:60] += 25  # outliers together
    df = spark.createDataFrame([("g", "en", k % 32, *map(float, r)) for k, r in enumerate(data)], "group string, lang string, salt int, " + ", ".join(f"{x} double" for x in xs))
    floor = np.diag(np.array(list(quality.FLOORS.values())) ** 2)
    lower = lambda a: np.sort(a, axis=0)[(len(a) - 1) // 2]
    mid = lower(data)
    scale = np.sqrt((1.4826 * lower(np.abs(data - mid))) ** 2 + np.diag(floor))

    def near(m: np.ndarray, c: np.ndarray) -> np.ndarray:
        d2 = np.einsum("ij,jk,ik->i", data - m, np.linalg.inv(c), data - m)
        bins = np.floor(np.log2(np.clip(d2, 0.25, 2.0**14)) * 16)
        return np.array([min(1, max(0, (0.75 * len(data) - (bins < b).sum()) / (bins == b).sum())) for b in bins])

    def moments(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = np.average(data, axis=0, weights=w)
        return m, np.cov(data.T, bias=True, aweights=w) * quality.CONSISTENCY + floor

    begun = quality.starts(df, True)
    assert sorted(r.start for r in begun.collect())[:1] == [0] and begun.count() > 1
    m, c = moments(near(mid, np.diag(scale**2)))
    for few in (True, False):
        got = quality.step(df, begun.where("start = 0"), few).first()
        assert [got[f"m_{x}"] for x in xs] == pytest.approx(m.tolist(), rel=1e-6, abs=1e-9)
        assert [got[f"f_{x}_{y}"] for x, y in quality.PAIRS] == pytest.approx(chol(c), rel=1e-6)
        assert got.log_det == pytest.approx(np.linalg.slogdet(c)[1], rel=1e-6)
    for _ in range(20):  # where steps from the medians lead to
        m, c = moments(near(m, c))
    best = quality.least_determinant(df).first()
    assert best.log_det <= np.linalg.slogdet(c)[1] + 1e-3
    low = np.zeros((5, 5))
    for x, y in quality.PAIRS:
        low[xs.index(x), xs.index(y)] = best[f"f_{x}_{y}"]
    m, c = np.array([best[f"m_{x}"] for x in xs]), low @ low.T
    assert moments(near(m, c))[0] == pytest.approx(m, abs=0.02)  # further steps change little
    assert (np.abs(m) < 1).all()  # far from the outliers
    n, c = best.n, c - floor
    prior = np.diag(np.array(list(quality.BROAD.values())) ** 2)
    for _ in range(2):  # of all rows, then of the language: here the group's own
        prior = (n * c + 50 * prior) / (n + 50)
    want = (n * c + 50 * prior) / (n + 50) + floor
    got = quality.outlier_model(df).first()
    assert [got[f"m_{x}"] for x in xs] == pytest.approx(m.tolist(), rel=1e-6, abs=1e-9)
    assert [got[f"f_{x}_{y}"] for x, y in quality.PAIRS] == pytest.approx(chol(want), rel=1e-6)
    inverse = np.linalg.inv(want)
    assert min(np.einsum("ij,jk,ik->i", data[:60] - m, inverse, data[:60] - m)) > quality.CUTOFF
    same = spark.createDataFrame([("g", "", 0, 1.0, 2.0, 3.0, 0.0, 0.0)] * 30, df.schema)  # ties
    tied = quality.outlier_model(same).first()
    assert [tied[f"m_{x}"] for x in xs] == pytest.approx([1, 2, 3, 0, 0]) and all(tied[f"f_{x}_{x}"] >= quality.FLOORS[x] for x in xs)


# 9


def naive_fingerprint(t: str | None) -> int:
    w = split(t)
    if not w:
        return 0
    h = [xxhash.xxh64(b" ".join(w[i : i + 3]), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps: list[int], ids: list) -> list:
    parent = list(range(len(fps)))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                parent[find(a)] = find(b)
    low: dict = {}
    for k, i in enumerate(ids):
        r = find(k)
        low[r] = min((x for x in (low.get(r), i) if x is not None), default=None)
    return [low[find(k)] for k in range(len(fps))]


def test_simhash_rows(spark, docs, none, rows):
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [naive_fingerprint(t) for _, t in rows]
    want = Counter(zip([i for i, _ in rows], fps, components(fps, [i for i, _ in rows])))
    assert got == want and simhash.near_duplicates(none).count() == 0
    first = simhash.first_of_each_class(docs)
    assert sorted(first.columns) == sorted(docs.columns)
    assert first.count() == len(set(components(fps, list(range(len(fps))))))


def test_simhash_links_are_complete(spark):
    rnd = random.Random(5)
    fps = []
    for _ in range(60):
        x = rnd.getrandbits(64)
        fps.append(x)
        for _ in range(rnd.randint(0, 4)):
            x ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4)))
            fps.append(x)
    fps = list(dict.fromkeys([*fps, 0, (1 << 64) - 1, 7, 1 << 63]))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    pairs = [(r.a, r.b) for r in edges.collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in pairs)
    got = {r.node: r.component for r in connected_components(edges).collect()}
    ours = [got.get(x, x) for x in signed]
    want = components(fps, signed)
    assert len(set(zip(ours, want))) == len(set(ours)) == len(set(want))


def test_simhash_many_buckets_and_other_columns(spark, docs, monkeypatch):
    want = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    monkeypatch.setattr(simhash, "BUCKET_VARIANTS", 1)  # so over 65536 / 561 fingerprints' buckets
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == want
    d = docs.withColumn("n", F.lit(3)).withColumn("hash", F.lit("x")).withColumn("__n", F.lit(9)).withColumn("a.b", F.lit(1))
    got = simhash.first_of_each_class(d).collect()
    assert len(got) == simhash.first_of_each_class(docs).count() and all((r.n, r.hash, r["__n"], r["__hash"], r["a.b"]) == (3, "x", 9, "clash", 1) for r in got)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[k] == 1000 for k in range(1000, 1400))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 10


def naive_dedup(rows: list[tuple]) -> dict:
    """By id and text the lines that stay: chunks, all runs of over 50 words and whole copies go."""

    def chunks(lines: list[str]) -> list[tuple[int, int]]:
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        long = [len(x.encode().split()) > 50 for x in lines]
        ends = [i for i in range(len(lines)) if (h[i] + (31 * h[i - 1] if i else 0)) % 1_000_003 % 3 == 0 or long[i] or i + 1 == len(lines) or long[i + 1]]
        cut = list(zip([0, *(e + 1 for e in ends)], ends))
        return [(a, e) for a, e in cut if e > a or long[e]]

    def all_runs(lines: list[str]) -> set[tuple[int, int]]:
        words = [len(x.encode().split()) for x in lines]
        return {(a, b) for a in range(len(lines)) for b in range(a, len(lines)) if sum(words[a : b + 1]) > 50} | {(0, len(lines) - 1)}

    out, first = {}, {}
    order = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    for d, (i, t) in enumerate(order):
        lines, gone = t.split("\n"), set()
        for a, b in sorted(all_runs(lines) | set(chunks(lines))):
            known = first.setdefault("\n".join(lines[a : b + 1]) + f"/{b - a}", (d, a))
            if known[0] < d or known[1] + b - a < a:
                gone.update(range(a, b + 1))
        out[i, t] = [x for k, x in enumerate(lines) if k not in gone]
    return out


def test_line_dedup_against_plain_python(spark, none):
    rnd = random.Random(21)
    shared = [[prose(rnd, rnd.randint(2, 12)) for _ in range(rnd.randint(4, 9))] for _ in range(4)]
    shared += [[prose(rnd, n) for n in ns] for ns in ((60,), (30, 30), (20, 20, 20), (15,) * 4, (10, 0, 10, 10, 25, 10), (6,) * 12)]
    rows = []
    for i in range(80):
        own = [prose(rnd, rnd.randint(1, 30)) for _ in range(rnd.randint(1, 8))]
        at = rnd.randrange(len(own) + 1)
        rows.append((i, "\n".join([*own[:at], *shared[i % 10], *own[at:]])))
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, ""), (None, rows[1][1]), (104, "\n\n\n"), (7, rows[7][1]), (105, "")]
    rows += [(110, "short\none"), (111, "short\none"), (112, "short\ntwo"), (113, "\n".join(["again and again"] * 40)), (114, "a\n" * 700), (115, "b " * 200_000 + "\nb")]
    d = spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], "doc_id long, text string, __gone string, claims int, line_dedup int, `a.b` string")
    got = line_dedup.dedup_lines(d).collect()
    want = naive_dedup(rows)
    assert len(got) == len(rows) and line_dedup.dedup_lines(d).columns == [*d.columns, "line_dedup_"]
    for r in got:
        assert (r["__gone"], r.claims, r.line_dedup, r["a.b"]) == ("x", 1, 2, "y")
        source = [t for i, t in rows if i == r.doc_id]
        assert r.text in {"\n".join(want[r.doc_id, t]) if t is not None else None for t in source}, r.doc_id
        if r.doc_id != 7:
            assert r.line_dedup_.n_removed_lines == (len(source[0].split("\n")) - len(want[r.doc_id, source[0]]) if source[0] is not None else 0)
            assert (r.line_dedup_.n_removed_runs > 0) == (r.line_dedup_.n_removed_lines > 0)
    for k, passage in enumerate(shared[4:]):  # nothing of a passage of over 50 words is left but once
        assert sum(max(passage, key=len) in (r.text or "") for r in got if r.doc_id != 7) <= 1, k
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_compares_bytes(spark, monkeypatch):
    """Where all hashes of runs collide only what is equal goes."""
    monkeypatch.setattr(line_dedup, "_run_hash", lambda c: F.lit(7).cast("long"))
    rows = [(1, "a b c"), (2, "d e f"), (3, "a b c")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "a b c" and got[2] == "d e f" and got[3] == ""


# pipeline


def test_pipeline_drops_copies_of_many_lines(spark, tmp_path, items):
    import corpus_pipeline

    rnd = random.Random(34)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    page = lambda: "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(8, 30))) for _ in range(12))
    clean = [(i, page()) for i in range(60)]
    near = [(400 + i, "\n".join([*t.split("\n")[:6], "quite another line " + " ".join(rnd.choice(words) for _ in range(60)), *t.split("\n")[6:]])) for i, t in clean[:20]]
    rows = [*clean, *[(200 + i, t) for i, t in clean], *near]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r.decoded for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: t for i, t in got.items() if i < 400} == dict(clean)
    assert {i: t for i, t in got.items() if i >= 400} == {i: t.split("\n")[6] for i, t in near}  # only what is new


def test_pipeline_keeps_clean_documents(spark, tmp_path, items):
    import corpus_pipeline

    rnd = random.Random(33)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    clean = [(i, text(rnd.randint(40, 200))) for i in range(100)]
    rows = [*clean, (200, clean[0][1]), (201, text(30) + " " + items[3] + " " + text(30)), (202, "too short"), (203, "again and again " * 60), (204, None), (None, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert sorted(r.doc_id for r in docs.collect()) == list(range(100))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == list(range(100))
    assert {r.doc_id: r.decoded for r in got.collect()} == dict(clean)


def test_pipeline_odd_tables(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(35)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(4000)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    long = "\n".join(text(40) for _ in range(4000))  # a megabyte
    rows = [(i, text(60), None, None) for i in range(30)] + [(None, text(60), "en", None), (40, None, None, "s"), (41, "", "en", "s"), (42, long, "en", "s"), (0, None, None, None)]
    extra = "quality string, line_dedup int, found boolean, __found boolean, __hash long, hash long, n int, `a.b` int"
    plain = spark.createDataFrame([(*r, "q", 1, True, True, 5, 6, 7, 8) for r in rows], "doc_id long, text string, lang string, source string, " + extra)
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None), (2, ""), (3, text(20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == plain.columns, name
        docs = corpus_pipeline.materialise(docs, name)
    got = docs.collect()
    assert {r.doc_id for r in got} == {*range(30), None, 42} and len(got) == 32
    assert all((r.quality, r.line_dedup, r.found, r["__found"], r["__hash"], r.hash, r.n, r["a.b"]) == ("q", 1, True, True, 5, 6, 7, 8) for r in got)
    assert {r.doc_id: r.decoded for r in corpus_pipeline.sentencepiece(spark, docs, str(tmp_path)).collect()}[42] == long
    (tmp_path / "none").mkdir()
    plain.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none/benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    for name, stage in corpus_pipeline.STAGES:  # each alone over all rows, nulls among them
        assert stage(spark, plain, str(tmp_path)).count() > 0, name


def test_buckets_of_ids(spark):
    d = spark.createDataFrame([(5,), (None,)], "doc_id long")
    got = [r[0] for r in d.select(bucket_of(F.col("doc_id"), 7)).collect()]
    assert got == [zlib.crc32(b"5") % 7, 0]
    assert texts(spark.createDataFrame([(1, None, 2)], "doc_id long, text string, x int")).first().text == ""
