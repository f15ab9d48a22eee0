"""The operators against brute force, on small tables with nulls, blanks, repeats and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import DATA
from waymark.llm import components, line_windows, mixing, packing, pii, pretokens, quality_net, quality_rules, queries, repeats, scratch, shingles, simhash, token_counts, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(spark, texts, first=0):
    return spark.createDataFrame([(None if i == 3 else i + first, t, None, f"s{i % 3}" if i % 7 else None, 0) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(0)
    words = ["the", "of", "kauri", "Rimu", "ähre", "b", "token", "Stone,", "river.", "x1", "####", "été"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = "\n".join(line(12) for _ in range(5))
    body = [line(rng.randint(1, 90)) + "\n" + line(rng.randint(1, 60)) for _ in range(40)]
    long = line(6000)
    return [
        None, "", "   \n\t", "one", "one two three", "a a a a a a a a a", passage, passage, passage + "\n" + line(30), line(40) + "\n" + passage + "\n" + line(9),
        long, long[:-5] + "zz", "ab" * 700, "x" * 600, "\n\n\n\n", "same\nlines\nhere\nsame\nlines\nhere\nsame\nlines\nhere", *body, *body[:4], "naïve ½ \x1c test 日本語 " * 12,
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return made(spark, texts).repartition(3)


def in_order(rows, texts):
    """Rows by place in ``texts``, the null id's row where it was."""
    return [next(r for r in rows if r.doc_id == (None if i == 3 else i)) for i in range(len(texts))]


def _without_repeats(body):
    """Length, removed bytes, spans and digest of each text, by brute force."""
    times = Counter(hash(b[i : i + 200]) for b in body for i in range(len(b) - 199))
    out = []
    for b in body:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if times[hash(b[i : i + 200])] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def _removed(rows):
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]


def test_repeats(spark, docs, texts):
    assert _removed(in_order(repeats.removed(docs).collect(), texts)) == _without_repeats([(t or "").encode() for t in texts])


def test_common_passages_in_changing_surroundings(spark):
    """A passage in 1,300 texts, in two kinds of surroundings that come several times; brute force over all."""
    rng = random.Random(12)
    noise = lambda n: f"{rng.getrandbits(4 * n):0{n}x}"
    passage, again = noise(260), [noise(120) for _ in range(3)]
    rows = [rng.choice([noise(150), again[0] + again[1]]) + passage + rng.choice([noise(130), again[2], again[2][:60] + noise(70)]) for _ in range(1300)]
    rows += [passage * 3, rows[5], passage[:199], "x" * 450]
    want = _without_repeats([t.encode() for t in rows])
    for common in (1000, 5, repeats.COMMON):
        got = repeats.removed(made(spark, rows, 10).repartition(4), common).collect()
        got = [next(r for r in got if r.doc_id == (None if i == 3 else i + 10)) for i in range(len(rows))]
        assert _removed(got) == want


def test_repeats_in_very_long_texts(spark):
    """Texts beyond a block, phrases beyond the longest, repeats across a block's end."""
    rng = random.Random(6)
    noise = lambda n: f"{rng.getrandbits(4 * n):0{n}x}"
    passage = noise(700)
    long = noise(repeats.BLOCK - 350) + passage + noise(90_000)
    rows = [long, noise(900) + passage[100:600] + noise(50), "x" * 3 * repeats.LONGEST, noise(300) + "x" * 5000 + noise(200), "ab" * 6000 + "c", noise(250), long[5000:5400], None]
    got = repeats.removed(made(spark, rows, 10).repartition(4)).collect()
    got = [next(r for r in got if r.doc_id == (None if i == 3 else i + 10)) for i in range(len(rows))]
    assert _removed(got) == _without_repeats([(t or "").encode() for t in rows])


def test_dictionary_beyond_one_sort():
    """Groups of more than ``SORTED`` bytes go through several sorts and none is torn."""
    rng = random.Random(8)
    rows, at = [], 0
    for g in range(900):
        stem = rng.randbytes(2400)
        for ph in range(2):  # they share all but their last bytes
            data = stem + bytes([ph]) + rng.randbytes(59)
            rows.append((g, 2 * g + ph, 1, len(data) - 199, data))
            at += len(data)
    assert at > 2 * repeats.SORTED
    names = ["v", "ph", "c", "n", "data"]
    columns = list(zip(*rows, strict=True))
    table = pa.Table.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names=names)
    out = [r for b in repeats._sorted_repeats(iter(table.to_batches(max_chunksize=333))) for r in b.to_pylist()]
    assert sorted((r["ph"], r["a"], r["b"]) for r in out) == [(ph, 0, 2400) for ph in range(1800)]


def test_repeats_of_a_very_common_line(spark):
    """The windows of a trigger of thousands of phrases are compared one by one, and nothing is missed."""
    rng = random.Random(1)
    line = "All rights reserved by the owners of this page and its parts."
    rows = [f"{rng.getrandbits(900):x}{line}{rng.getrandbits(900):x}" for _ in range(1300)]
    rows += [rows[0][40:300] + "q", rows[1]]
    got = repeats.removed(made(spark, rows, 10).repartition(5), common=1000).collect()
    removed = {r.doc_id: r.n_removed for r in got}
    hit = {10: 260, 11: len(rows[1]), 10 + 1300: 260, 10 + 1301: len(rows[1])}
    assert {k: v for k, v in removed.items() if v} == hit


def test_suffix_ranks():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 900).astype(np.uint8)
    data = np.concatenate([data, data[100:600]])
    keys = [data[i : i + 200].tobytes().ljust(200, b"\0") for i in range(len(data))]
    rank = repeats.suffix_ranks(data)
    order = sorted(range(len(data)), key=lambda i: keys[i])
    assert all((keys[a] == keys[b]) == (rank[a] == rank[b]) and rank[a] <= rank[b] for a, b in zip(order, order[1:], strict=False))


def test_token_counts(docs, texts):
    vocabulary = token_counts.scores(pretokens.default_path("byte_bpe_50k.tiktoken"))

    def best(w):
        at = [(0, 0)]
        for e in range(1, len(w) + 1):
            at.append(max((at[i][0] + vocabulary[w[i:e]], at[i][1] - 1) for i in range(max(0, e - 128), e) if w[i:e] in vocabulary))
        return at[-1]

    short = [t if t is None or len(t) < 3000 else t[:400] for t in texts]
    got = in_order(token_counts.counted(docs.withColumn("text", F.when(F.length("text") < 3000, F.col("text")).otherwise(F.substring("text", 1, 400)))).collect(), texts)
    for t, r in zip(short, got, strict=True):
        found = [best(w) for w in pretokens.plain_cut(t or "")]
        assert (r.n_pretokens, r.n_tokens) == (len(found), -sum(x[1] for x in found))
        assert r.log_prob == sum(x[0] for x in found) / token_counts.UNIT


def test_pretokens_and_ids(texts):
    from tokenizers import Tokenizer

    path = pretokens.default_path("byte_bpe_50k.json")
    whole, own = Tokenizer.from_file(path), pretokens.Ids(path, pretokens.default_path("byte_bpe_50k.tiktoken"))
    rng = random.Random(2)
    signs = " \t\n'srevlmdab1.é2,?ß  "
    many = [t or "" for t in texts] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["<|endoftext|> it's", "\x85  "]
    for t, ids in zip(many, own.of(many), strict=True):
        assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(pretokens.default_path("byte_bpe_50k.json"))
    rows = packing.packed(docs).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(pieces[None if i == 3 else i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0  # nothing is padded


def test_sum_of_squares_choice():
    rng = random.Random(0)
    p = packing.Packer(16)
    for _ in range(400):
        size = rng.randint(1, 15)
        before = p.counts.copy()
        scores = {}
        for h in range(16 - size + 1):
            if h == 0 or before[h]:
                after = before.copy()
                after[h] -= h > 0
                after[h + size] += h + size < 16
                scores[h] = int((after**2).sum())
        p.take((0, 0, 0, np.zeros(size, np.uint32)))
        assert int((p.counts**2).sum()) == min(scores.values())


def test_mixing(spark, docs, texts):
    got = mixing.mixed(docs.withColumn("sources", F.array("source"))).collect()
    again = mixing.mixed(docs.repartition(5).withColumn("sources", F.array("source"))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(texts)
    size, total = {(None if i == 3 else i): len(WORD.findall(t or "")) for i, t in enumerate(texts)}, defaultdict(int)
    source = {r.doc_id: r.source for r in docs.collect()}
    for d, n in size.items():
        total[source[d]] += n
    taken = defaultdict(int)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == total[source[r.doc_id]] and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    largest = defaultdict(int)
    for d, n in size.items():
        largest[source[d]] = max(largest[source[d]], n)
    for r in got:
        assert abs(taken[source[r.doc_id]] - r.target) <= largest[source[r.doc_id]] / 2 + 1


def test_targets_and_flow():
    t = mixing.targets({"a": 100, "b": 1000, None: 10, "c": 5})
    assert sum(t.values()) == Fraction(3, 2) * 1115 and all(t[s] <= 2 * n for s, n in {"a": 100, "b": 1000, None: 10, "c": 5}.items())
    f = mixing.flow({frozenset("a"): 10, frozenset("ab"): 10, frozenset("bc"): 5}, {"a": 5, "b": 20, "c": 3})
    assert sum(f.values()) == 28 and f[frozenset("ab")] + f[frozenset("bc")] + f[frozenset("a")] == 28
    assert sum(max(0, f[p] - n) for p, n in ((frozenset("a"), 10), (frozenset("ab"), 10), (frozenset("bc"), 5))) == 8  # the least repetition
    assert mixing.targets({"a": 0}) == {"a": 0}


def test_overlapping_sources(spark):
    """Patterns of one and two sources: words go by the flow, each source gets its target, nothing more often than needed."""
    rng = random.Random(7)
    rows = [(i if i % 50 else None, " ".join("w" * 3 for _ in range(rng.randint(1, 30))) + f" t{i}", rng.choice((["a"], ["a", "b"], ["b", "c"], ["c"], ["b", "a"]))) for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    got = mixing.mixed(d).collect()
    sizes, have = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        have[frozenset(s)] += len(t.split())
        for x in s:
            sizes[x] += len(t.split())
    wanted = {s: int(t + Fraction(1, 2)) for s, t in mixing.targets(dict(sizes)).items()}
    gives = mixing.flow(dict(have), wanted)
    assert len(got) == 900 and all(0 <= r.taken <= 2 * r.size for r in got)
    cuts = [frozenset(c) for n in range(4) for c in combinations("abc", n)]
    assert sum(gives.values()) == min(sum(wanted[s] for s in cut) + sum(2 * n for p, n in have.items() if not p <= cut) for cut in cuts)  # the largest flow
    sized, table = mixing.planned(d)
    taken = defaultdict(int)
    for r in sized.join(table, "pattern").withColumn("n", F.col("size") * mixing.copies()).collect():
        taken[frozenset(r.sources)] += r.n
    assert all(abs(taken[p] - gives[p]) <= 31 for p in gives)  # to the nearest document
    mixing.MOST_PATTERNS, most = 3, mixing.MOST_PATTERNS
    try:
        with pytest.raises(ValueError):
            mixing.planned(d)
    finally:
        mixing.MOST_PATTERNS = most


def test_rows_without_an_id_are_apart(spark):
    d = spark.createDataFrame([(None, f"word {i} again", ["s" if i % 10 else "t"]) for i in range(400)], "doc_id long, text string, sources array<string>")
    got = mixing.mixed(d).collect()
    for s in {r.source_size for r in got}:
        mine = [r for r in got if r.source_size == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 3


def test_mixture_repeats_documents(spark, docs):
    plan = {r.doc_id: r for r in mixing.mixed(docs.withColumn("sources", F.array("source"))).collect()}
    out = Counter(r.doc_id for r in mixing.sampled(docs).collect())
    assert out == Counter({d: r.taken // r.size for d, r in plan.items() if r.taken})
    assert mixing.sampled(docs).columns == docs.columns


def _base(text):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d):
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_pii(spark):
    rng = random.Random(3)
    many = ["".join(rng.choice("a1.@-+ 2(5)é") for _ in range(60)) for _ in range(3000)] + [t for t, _ in pii._made(5, 200)] + ["mail a@b.co_c@d.e.f, 4539 1488 0343 6467 +1 (988) 555-2485", "1" * 50_000, "a" * 50_000 + "@"]
    for t in many:
        assert pii.base(t) == _base(t) if len(t) < 1000 else pii.base(t) == []
    d = made(spark, [None, "", *many[-203:]], 0)
    for r in pii.found(d).collect():
        t = d.where(F.col("doc_id").eqNullSafe(r.doc_id)).first().text or "" if r.doc_id in (0, 1, 150) else None
        if t is not None:
            listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in _base(t))
            assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
            assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_field_learns_and_keeps_clean_text_clean():
    w, right, all_, wrong = pii.weights(), 0, 0, 0
    for text, truth in pii._made(99, 300):
        got = set(pii.added(text, [], w))
        right, all_, wrong = right + len(got & truth), all_ + len(truth), wrong + len(got - truth)
    assert right / all_ > 0.85 and wrong / all_ < 0.05
    assert pii.added("On 2024-05-06 it cost 1,299.00 in version 1.2.3, page 12-14, ISBN 978-3-16-148410-0.", [], w) == []


def test_field_gradient():
    text, truth = "call +44 20 7946 0018 now", {(5, 21, 3)}
    bounds, segments = pii._lattice(text, 5, 21)
    rng = random.Random(0)
    w = {x: rng.uniform(-1, 1) for s in segments for x in s[3]}

    def likelihood(w):
        def total(i):
            if i == len(bounds) - 1:
                return [(0.0, frozenset())]
            out = [(v, s) for v, s in total(i + 1)]
            for a, b, k, names in segments:
                if a == i:
                    out += [(v + sum(w.get(x, 0) for x in names), s | {(bounds[a], bounds[b], k)}) for v, s in total(b)]
            return out

        every = total(0)
        return max(v for v, s in every if s == truth) - np.log(sum(np.exp(v) for v, _ in every))

    g = pii._gradient(bounds, segments, truth, w)
    for x in list(g)[:6]:
        up, down = dict(w), dict(w)
        up[x] += 1e-5
        down[x] -= 1e-5
        assert abs((likelihood(up) - likelihood(down)) / 2e-5 - g[x]) < 1e-4


def test_topk(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-40, 40, (700, 12)).astype(float)
    x[5] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (900, None), (901, [None] * 12), (902, [float("nan")] * 12), (950, [1.0, 2.0])]
    got = topk.top(spark.createDataFrame(rows, "vec_id long, x array<double>").repartition(3), F.col("vec_id") % 50 == 0, block=256, query_block=8).collect()
    sound = [(i, np.array(v)) for i, v in rows if v and len(v) == 12 and all(c is not None and c == c for c in v)]
    want = Counter()
    for n, (i, v) in enumerate(sound):
        if i % 50 == 0:
            best = sorted((-int(u @ v), j) for m, (j, u) in enumerate(sound) if m != n)[:5]
            want.update((i, r, j, -s) for r, (s, j) in enumerate(best, 1))
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want


def test_lists_stop_early():
    rng = np.random.default_rng(1)
    for x, most in ((np.abs(rng.normal(0, 1, (5000, 3)) ** 5 * 100).astype(np.int64), 0.5), (np.floor(rng.normal(0, 32, (6000, 64))).astype(np.int64), 0.95)):
        lists, d = topk.Lists(x), x.shape[1]
        for query, own in ((x[9], 9), (np.resize([3, 1, 2], d), -1), (np.resize([-1, -1, -2], d), 7), (np.resize([1, 0, -5], d), -1), (np.zeros(d, np.int64), -1)):
            left, share = lists.best(query, 5, 64, own)
            score = x @ query
            if own >= 0:
                score[own] = score.min() - 1
            assert set(np.flatnonzero(score >= np.sort(score)[-5])) <= set(left)
            if query.max() > 0:  # else the best are ties at nothing
                assert len(left) <= 64 and share < most


def test_topk_of_hot_vectors_empty_ones_and_clashing_columns(spark):
    """A third of all rows is one vector: ties go to the smaller ids."""
    rng = np.random.default_rng(2)
    rows = [(i, [3.0, -4.0, 5.0] if i % 3 == 0 else rng.integers(-5, 5, 3).astype(float).tolist(), i) for i in range(600)] + [(1000, [], 0), (1050, [], 0), (1001, [], 0)]
    d = spark.createDataFrame(rows, "vec_id long, x array<double>, row long").withColumns({"width": F.lit("w"), "qb": F.lit(1), "cb": F.lit(2)})
    got = defaultdict(list)
    for r in sorted(topk.top(d, F.col("vec_id") % 50 == 0, block=128, query_block=4).collect(), key=lambda r: r.rank):
        got[r.query_id].append((r.vec_id, r.score))
    assert got[1000] == [(1001, 0), (1050, 0)] and got[1050] == [(1000, 0), (1001, 0)]
    for i in range(0, 600, 50):
        best = sorted((-int(np.dot(v, rows[i][1])), j) for j, v, _ in rows[:600] if j != i)[:5]
        assert got[i] == [(j, -s) for s, j in best]


def test_lines(docs, texts):
    seen, got = set(), {r.doc_id: r for r in line_windows.deduplicated(docs).collect()}
    for i in [*[j for j in range(len(texts)) if j != 3], 3]:  # the null id is last
        lines = (texts[i] or "").split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if WORD.search("".join(w)):
                gone |= {p, p + 1, p + 2} if w in seen else set()
                seen.add(w)
        r = got[None if i == 3 else i]
        assert (r.n_lines, r.n_removed, r.text) == (len(lines), len(gone), "\n".join(x for p, x in enumerate(lines) if p not in gone))


def test_quality_counts_and_verdicts(spark, docs, texts):
    got = in_order(quality_rules.judge(docs).collect(), texts)
    for t, r in zip(texts, got, strict=True):
        t = t or ""
        w = WORD.findall(t)
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)


def _estimated(rows, rounds, b=quality_rules.Belief()):
    """Expectation-maximisation as a plain loop, and the posterior it ends with."""
    total, k_all = sum(rows.values()), range(len(next(iter(rows))))
    weight = total * b.weight + 1
    prior, good, bad = b.good, [b.alarm_good for _ in k_all], [b.alarm_bad for _ in k_all]

    def post(v):
        odds = np.log(prior / (1 - prior)) + sum(np.log(good[k] / bad[k]) if x == -1 else np.log((1 - good[k]) / (1 - bad[k])) if x == 1 else 0 for k, x in enumerate(v))
        return 1 / (1 + np.exp(-odds))

    for _ in range(rounds):
        p = {v: post(v) for v in rows}
        prior = (sum(n * p[v] for v, n in rows.items()) + weight * b.good) / (total + weight)
        share = lambda f, k, believed, w: (sum(n * f(p[v]) for v, n in rows.items() if v[k] == -1) + w * believed) / (sum(n * f(p[v]) for v, n in rows.items() if v[k]) + w)  # noqa: B023, E731
        good = [share(lambda g: g, k, b.alarm_good, weight) for k in k_all]
        bad = [share(lambda g: 1 - g, k, b.alarm_bad, weight * (1 - b.good)) for k in k_all]
    return prior, good, bad, post


def test_quality_estimation(spark):
    """The nested expression gives what a plain loop gives."""
    rng = random.Random(0)
    rows = Counter()
    for _ in range(4000):
        good = rng.random() < 0.8
        rows[tuple(0 if rng.random() < 0.2 else (1 if rng.random() > (0.001 if good else p) else -1) for p in (0.6, 0.3, 0.5))] += 1
    d = spark.createDataFrame([(list(k), n) for k, n in rows.items()], "votes array<int>, n long")
    got = quality_rules.estimated(d, 3, 8).first()
    prior, good, bad, _ = _estimated(rows, 8)
    assert np.allclose([got.prior, *got.alarm_good, *got.alarm_bad], [prior, *good, *bad])
    none = quality_rules.estimated(d.where("false"), 3, 8).first()
    assert np.allclose([none.prior, *none.alarm_good, *none.alarm_bad], [0.85, 0.01, 0.01, 0.01, 0.15, 0.15, 0.15])


def test_a_wrong_rule_is_outvoted(spark):
    """A rule that says bad of a third of all documents, whatever they are, loses its say; the others keep theirs."""
    rng = random.Random(1)
    rows, truth = Counter(), {}
    for _ in range(6000):
        good = rng.random() < 0.85
        v = tuple(1 if rng.random() > (0.005 if good else 0.6) else -1 for _ in range(4)) + (-1 if rng.random() < 0.33 else 1,)
        rows[v] += 1
        truth.setdefault(v, Counter())[good] += 1
    d = spark.createDataFrame([(list(k), n) for k, n in rows.items()], "votes array<int>, n long")
    state = quality_rules.estimated(d, 5).first()
    assert state.alarm_good[4] > 0.25 and all(x < 0.02 for x in state.alarm_good[:4]) and all(x > 0.4 for x in state.alarm_bad[:4])
    post = {tuple(r.votes): r.p for r in d.select("votes", quality_rules.posterior(F.col("votes"), F.struct(*[F.lit(state[x]).alias(x) for x in ("prior", "alarm_good", "alarm_bad")])).alias("p")).collect()}
    assert post[(1, 1, 1, 1, -1)] > 0.9  # its lone vote is outvoted
    assert post[(-1, -1, 1, 1, 1)] < 0.1  # two of the others decide
    right = sum(n for v in truth for good, n in truth[v].items() if (post[v] >= 0.5) == good)
    assert right / 6000 > 0.97


def test_lone_bad_votes_fall_on_both_sides(spark):
    """Over the driver's documents, a bad vote alone decides for some rules and is outvoted for others."""
    judged = quality_rules.judge(spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/documents.parquet").select("doc_id", "text"))
    lone = judged.where(F.size(F.filter("votes", lambda v: v == -1)) == 1)
    sides = {r.good: r.n for r in lone.groupBy((F.col("p_good") >= 0.5).alias("good")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sides[True] > 0 and sides[False] > 0


def test_quality_net(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{n}.parquet") for n in ("documents", "labels"))
    net = quality_net.fitted(docs, labels)
    changed = labels.withColumn("quality", F.when(quality_net.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert all(np.array_equal(a, b) for a, b in zip(net.parts(), quality_net.fitted(docs.repartition(7), changed).parts(), strict=True))  # held-out labels are never read
    rows = quality_net.scored(docs, net).join(labels, "doc_id").where(quality_net.held_out()).collect()
    right = np.mean([(r.score >= 0.7) == r.quality for r in rows])
    assert right > 0.85 and all(0 <= r.score <= 1 for r in rows)
    own = quality_net.Scorer(net)
    some = [b"", b"a", b"word " * 700, b"x" * 511, b"y" * 512, b"z" * 1030]
    assert np.allclose(own.scores(some), [own.scores([x])[0] for x in some], atol=1e-6)
    assert len(quality_net.fitted(docs, labels.where("false")).parts()) == 5


def _fingerprint(t):
    w = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(docs, texts):
    assert [simhash.fingerprint(t) for t in texts] == [_fingerprint(t) for t in texts]
    rng, base = random.Random(0), random.Random(9).getrandbits(64)
    near = {base}
    while len(near) < 700:
        near.add(rng.choice(sorted(near)[:200]) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    far = {rng.getrandbits(64) for _ in range(500)}
    fps = np.array(sorted(near | far), np.uint64)
    d = docs.sparkSession.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for block in (8192, 64, 1):  # 64 and 1: longer lists go by the words between
        root = {r.node: r.root for r in components.components(simhash.links(d, block=block)).collect()}
        parent = {int(x): int(x) for x in fps.view(np.int64)}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, x in enumerate(fps):
            for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ x) <= 4) + i + 1:
                a, b = find(int(fps.view(np.int64)[i])), find(int(fps.view(np.int64)[j]))
                parent[max(a, b)] = min(a, b)
        assert all(root.get(x, x) == find(x) for x in parent)
    out = in_order(simhash.near_duplicates(docs).collect(), texts)
    assert out[6].component_id == out[7].component_id == 6 and out[0].component_id == out[1].component_id == out[2].component_id == 0
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and len(kept.collect()) <= len({r.component_id for r in out})


def test_representatives_of_near_copies(spark):
    """Copies with a word in forty changed go, texts of other words stay."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    base = [[rng.choice(words) for _ in range(rng.randint(150, 500))] for _ in range(40)]
    rows = [" ".join(b) for b in base]
    for b in base[:20]:
        for _ in range(6):
            c = list(b)
            for i in rng.sample(range(len(c)), len(c) // 100):
                c[i] = rng.choice(words)
            rows.append(" ".join(c))
    kept = {r.doc_id for r in simhash.representatives(made(spark, rows, 100)).collect()}
    assert {r - 100 for r in kept if r is not None} >= set(range(40)) - {3} and len(kept) <= 40 + 6  # the null id's row counts as last


def _shingles(t):
    w = t.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_links_are_the_pairs_at_the_similarity(spark):
    """Brute force over pairs at 0.7 to 0.95, in short lists and, by blocks, in long ones: all at 0.8 or more are connected, none below is."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    texts = []
    for k in range(60):
        base = [rng.choice(words) for _ in range(240)]
        for _ in range(60 if k < 3 else 2):  # three large groups
            c = list(base)
            for i in rng.sample(range(len(c)), rng.randint(1, 9) if k >= 3 else rng.randint(0, 5)):
                c[i] = rng.choice(words)
            texts.append(" ".join(c))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = docs.withColumn("_k", F.xxhash64("doc_id", "text"))
    marked = shingles.marked(keyed).cache()
    id_of = {r.doc_id: r.id for r in marked.collect()}
    sets = [_shingles(t) for t in texts]
    assert all(len(shingles.shingles(t)) == len(s) for t, s in zip(texts, sets, strict=True))
    parent, bands = list(range(len(texts))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            both = len(sets[i] & sets[j])
            share = both / (len(sets[i]) + len(sets[j]) - both)
            bands[int(share * 20 + 1e-9)] += 1
            if share >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert all(bands[b] for b in range(14, 19))
    distinct = marked.dropDuplicates(["id"]).select("id", "_k", "bands")
    root = {i: i for i in id_of.values()}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in shingles.links(keyed, distinct, 0.8, block=40).collect():
        root[max(top(r.a), top(r.b))] = min(top(r.a), top(r.b))
    met = {(find(i), top(id_of[i])) for i in range(len(texts))}
    assert len(met) == len({a for a, _ in met}) == len({b for _, b in met})
    kept = {r.doc_id for r in simhash.representatives(docs).collect()}
    assert kept == {find(i) for i in range(len(texts))}


def test_a_list_of_drifting_copies(spark):
    """One list of texts that drift away from their leader, in three chains and some strangers: the classes are those of all pairs."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    texts = []
    for size in (70, 25, 3):
        now = [word() for _ in range(200)]
        for _ in range(size):
            texts.append(" ".join(now))
            now = list(now)
            for i in rng.sample(range(200), 3):
                now[i] = word()
    texts += [" ".join(word() for _ in range(50)) for _ in range(12)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "_k long, text string")
    marked = shingles.marked(docs).withColumn("bands", F.array(F.lit(7).cast("long"))).cache()
    id_of = {r._k: r.id for r in marked.collect()}
    sets = [_shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert 15 <= len({find(i) for i in range(len(texts))}) < 40
    for block in (1024, 16):
        got = {r.node: r.root for r in components.components(shingles.links(docs, marked.select("id", "_k", "bands"), 0.8, block=block)).collect()}
        met = {(find(i), got.get(id_of[i], id_of[i])) for i in range(len(texts))}
        assert len(met) == len({a for a, _ in met}) == len({b for _, b in met})


def test_long_lists_link_as_short_ones(spark):
    """A dense group: the words between give the same groups as the index."""
    rng = random.Random(5)
    near = [rng.getrandbits(64)]
    for _ in range(400):
        near.append(rng.choice(near) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    fps = np.array(sorted(set(near)), np.uint64)
    d = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    groups = []
    for radius_two in (True, False):
        e = simhash._between(d, 2) if radius_two else spark.createDataFrame([(int(x), int(y)) for x, y in zip(*(v.view(np.int64) for v in simhash.forest(fps, 4)), strict=True)], "a long, b long")
        groups.append({r.node: r.root for r in components.components(e).collect()})
    assert groups[0] == groups[1] and len(groups[0]) > 100
    pairs = {(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}
    index = simhash.Index(fps)
    assert pairs <= {(i, j) for i in range(len(fps)) for j in index.sharing(i, 4).tolist() if j < i}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (7, 7), (901, 900)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[901] == 900 and 7 in got
    components.PER_TASK, whole = 16, components.PER_TASK  # several tasks, none of which sees a whole chain
    try:
        assert {r.node: r.root for r in components.components(edges.repartition(5)).collect()} == got
    finally:
        components.PER_TASK = whole
    assert components.components(edges.where("false")).count() == 0


def test_empty_tables_and_clashing_columns(spark, docs):
    none = docs.where("false")
    clash = docs.limit(8).withColumns({"k": F.lit(1), "fp": F.lit("x"), "n_words": F.lit(2), "kept": F.lit(True), "size": F.lit(0), "v": F.lit(""), "at": F.lit(0), "pattern": F.lit("p"), "spans": F.lit(0), "component": F.lit(0)})
    for d in (none, clash):
        n = d.count()
        assert repeats.removed(d.select("doc_id", "text", *[c for c in d.columns if c not in ("doc_id", "text")])).count() == n
        assert token_counts.counted(d).count() == n
        assert mixing.mixed(d.withColumn("sources", F.array("source"))).count() == n
        assert pii.found(d).count() == n
        assert line_windows.deduplicated(d).count() == n
        assert quality_net.scored(d, quality_net.Net.fresh()).count() == n
        assert simhash.near_duplicates(d.select("doc_id", "text")).count() == n
        assert quality_rules.judge(d.select("doc_id", "text")).count() == n
        assert packing.packed(d).select("doc_id").distinct().count() == n
        assert mixing.sampled(d).columns == d.columns
    assert topk.top(spark.createDataFrame([], "vec_id long, x array<double>"), F.col("vec_id") % 50 == 0).count() == 0
    scratch.release(spark)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    assert a.equals(b)


def test_field_reads_long_rows_of_numbers():
    """No number in a long row is cut where a stretch ended."""
    w = pii.weights()
    for one, kind in (("555-234-{:04d}", 3), ("4539 1488 0343 6467", 2)):
        numbers = [one.format(1000 + 7 * i) for i in range(12)]
        text = " ".join(numbers)
        at, spans = 0, set()
        for n in numbers:
            spans.add((at, at + len(n), kind))
            at += len(n) + 1
        assert pii.stretches(text) == [(0, len(text))]
        bounds, segments = pii._lattice(text, 0, len(text))
        assert spans <= {(bounds[i], bounds[j], k) for i, j, k, _ in segments}
        assert all(0 <= a < b <= len(text) for a, b, _ in pii.added(text, [], w))


def test_personal_data_in_very_long_texts(spark):
    """A megabyte of each kind of text takes seconds, and what stands in it is found."""
    n = 1_000_000
    parts = ["a" * n, "1" * n, "." * n, "a1" * (n // 2), "a." * (n // 2), "1 2 3 " * (n // 6), "12-34-" * (n // 6), "1." * (n // 2), "a@" * (n // 2), "(at)" * (n // 4), "+1(" * (n // 3), "555-234-1000 " * (n // 13), "a@b.cc " * (n // 7), " " * n, "4539 1488 0343 6467 " * (n // 20), "x.y-" * (n // 4) + "@b.cc"]
    end = " Call (555) 234-1000 or write joe [at] example [dot] org, mail b@c.de"
    w = pii.weights()
    for part in parts:
        began = time.perf_counter()
        text = part + end
        fixed = pii.base(text)
        spans = {(text[a:b], k) for a, b, k in fixed + pii.added(text, fixed, w)}
        assert ("b@c.de", 0) in spans and ("joe [at] example [dot] org", 0) in spans, part[:20]
        assert time.perf_counter() - began < 20, part[:20]
    row = pii.found(made(spark, ["word" * 300_000 + end], 1)).first()
    assert row.n_email == 1 and row.n_added >= 2


def test_long_emails_are_candidates():
    text = "write john.smith [at] mail.example [dot] co [dot] uk now"
    assert [text[a:b] for a, b, k in pii.added(text, [], pii.weights()) if k == 0] == ["john.smith [at] mail.example [dot] co [dot] uk"]


def test_very_long_pretokens(spark):
    """A pre-token of a megabyte is scored by itself, as the trie would."""
    own = token_counts.counter(pretokens.default_path("byte_bpe_50k.tiktoken"))
    for word in (b"abab" * 500, b"x" * 3000, b"information" * 90):
        own.learn({word})
        assert own.alone(word) == own.known[word]
    long = "ab" * 500_000
    r = token_counts.counted(made(spark, [long, "ab " + long + " c"], 10)).orderBy("doc_id").collect()
    assert r[0].n_pretokens == 1 and r[0].n_tokens > 0 and r[1].n_tokens >= r[0].n_tokens + 2


def test_packing_of_long_texts_and_many_open_sequences(spark):
    """Texts beyond a chunk; sequences that are topped up as soon as few are open; none of it loses or repeats an id."""
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma,", "x1", "été", "\n"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((1, 40, 300, 700)))) for _ in range(150)] + ["word " * 300_000, "", None]
    d = made(spark, texts, 10).repartition(3)
    for most in (8192, 3):
        rows = packing.packed(d, most_open=most).collect()
        pieces, fill = defaultdict(list), Counter()
        for r in rows:
            pieces[r.doc_id].append(r)
            fill[r.sequence_id] += r.length
        assert len(pieces) == len(texts) and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
        for held in pieces.values():
            held.sort(key=lambda r: r.start)
            assert [r.start for r in held] == [sum(x.length for x in held[:i]) for i in range(len(held))] and sum(r.length for r in held) == held[0].doc_tokens
        assert all(n <= 1024 and n & (n - 1) == 0 for n in fill.values()) and sum(n < 1024 for n in fill.values()) <= 10


def test_topping_up_keeps_the_fullest(spark):
    p = packing.Packer(16)
    for i, size in enumerate([15, 14, 13, 9, 9, 3, 2]):
        p.take((i, size, 0, np.arange(size, dtype=np.uint32)))
    open_ = [[x[0] for x in s] for level in p.open for s in level]
    full = p.topped()
    assert all(sum(len(x[3]) for x in s) == 16 for s in full) and p.n_open <= 1
    ids = [(x[0], x[2] + i) for s in full + [s for level in p.open for s in level] for x in s for i in range(len(x[3]))]
    assert len(ids) == len(set(ids)) <= 65 and len(open_) >= 2


def test_rows_that_repeat_id_and_text_are_one_place(spark):
    text = "one line\ntwo lines\nthree lines\nfour"
    d = spark.createDataFrame([(None, text), (None, text), (5, text), (5, text), (7, text)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_removed) for r in line_windows.deduplicated(d).collect())
    assert got == Counter({(5, 0): 2, (7, 4): 1, (None, 4): 2})


def test_convolution_by_plain_loops():
    """Chunks of two blocks, overlapping by one, to the end of a text: filters, pooling and the mean as loops."""
    net = quality_net.Net.fresh(3)
    own, rng = quality_net.Scorer(net), np.random.default_rng(4)
    for size in (0, 1, 5, 6, 511, 512, 513, 1024, 1500, 3000):
        text = rng.integers(32, 123, size).astype(np.uint8).tobytes()
        data = np.frombuffer(text + bytes(quality_net.WIDTH), np.uint8)
        places = [sum(net.table[j][data[p + j]] for j in range(quality_net.WIDTH)) for p in range(size + 1)]
        blocks = [np.max(places[i : i + quality_net.BLOCK], axis=0) for i in range(0, size + 1, quality_net.BLOCK)]
        chunks = [np.maximum(a, b) for a, b in zip(blocks, blocks[1:], strict=False)] or blocks
        logits = [float(np.maximum(c @ net.a + net.b, 0) @ net.c + net.d[0]) for c in chunks]
        assert abs(own.scores([text])[0] - 1 / (1 + np.exp(-np.mean(logits)))) < 1e-5
