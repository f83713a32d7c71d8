"""Token files, source mixing, near-duplicates, decontamination and the pipeline against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import frame, words  # tests/llm/conftest.py
from pyspark.sql import functions as F

import corpus_pipeline
from plenum.llm import decontaminate as dc
from plenum.llm import near_dedup as nd
from plenum.llm import queries
from plenum.llm import source_mix as sm
from plenum.llm import token_files as tf
from plenum.llm.common import table


@pytest.mark.parametrize("kind", ["wide", "zeros", "bits", "huge", "none"])
def test_packing(kind):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 40, 300)
    n = int(lengths.sum())
    values = {"wide": rng.integers(0, 50257, n), "zeros": np.zeros(n), "bits": rng.integers(0, 2, n), "huge": rng.integers(0, 2**63, n) * 2 + 1, "none": np.zeros(0)}[kind].astype(np.uint64)
    if kind == "huge":
        values[:3] = [2**60 - 1, 2**60 - 2, 2**64 - 1]
    if kind == "none":
        lengths = np.zeros(0, np.int64)
    packed, escapes, at = tf.pack(values, lengths)
    assert (tf.unpack(packed, escapes) == values).all()
    if kind in ("wide", "zeros", "bits"):  # each document by itself
        ends = np.cumsum(lengths)
        for k, (a, b) in enumerate(zip(at, [*at[1:], len(packed)], strict=True)):
            assert (tf.unpack(packed[a:b], escapes) == values[ends[k] - lengths[k] : ends[k]]).all()


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


#: Texts with added tokens (one of them nearly), and with other white space than single ones.
SPECIAL = ["<|endoftext|>", "x <|endoftext|> y", "x<|endoftext|>y z", "a\n<|endoftext|>\nb", "<|endoftext|> <|endoftext|>", "<|endoftext |>", "<|ENDOFTEXT|> a", "it's 12\n'll", "a  b", " a", "a\r\nb"]


def test_encoder_equals_the_library():
    encoder, r = tf.WordEncoder(queries.tokenizer_path(), keep=30), random.Random(3)
    for _ in range(10):
        texts = ["".join(r.choices(" \n\t'abcé1.! 　漢Ġ\x0b", k=r.randint(0, 14))) for _ in range(300)] + SPECIAL
        assert [x.tolist() for x in encoder(pa.array(texts), 0)] == library_ids(texts)


def test_encoder_asks_the_model_for_a_piece_once():
    encoder, plain = tf.WordEncoder(queries.tokenizer_path()), words(5, 3000)
    encoder(pa.array([" ".join(plain)]), 0)
    asked, texts = len(encoder.pieces), [" ".join(w + m for w in plain) for m in (",", "!?", "\n")]
    got = encoder(pa.array(texts), 0)
    assert [g[:-1].tolist() for g in got] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    # the marks, and words that a line feed precedes
    assert len(encoder.pieces) <= 2 * asked + 2


def test_encoder_with_few_words_kept():
    encoder, r = tf.WordEncoder(queries.tokenizer_path(), keep=40), random.Random(8)
    odd = ["'s", "it's", "'Tis", "don't,", "a1b2", "...", "x²", "ª", "naïve", "ſ", "ﬁn", "日本", "e\u0301", "\u00ad", "Ωm", "a\x1cb", "\x00", "_a_", "¿qué?", "<|endoftext|>", "l'œuvre", "’s", "٣", "ΐ", "I'LL", "a\u200bb", "'", "''s"]
    for _ in range(40):
        texts = ["".join(r.choice(odd + words(r.randrange(99), 5)) + r.choice([" ", " ", "\n", ""]) for _ in range(r.randrange(30))) for _ in range(8)]
        got = encoder(pa.array(texts), 0)
        assert [g[:-1].tolist() for g in got] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = sorted(queries.op2_token_files(spark, sf).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, ids in zip(rows, library_ids([docs[d] for d in sorted(docs)]), strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_odd(spark, odd, empty):
    rows = tf.token_files(odd, queries.tokenizer_path(), shards=3, block_ids=64).collect()
    assert len(rows) == odd.count()
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in rows), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in ordered] == np.concatenate([[0], np.cumsum([r.n_tokens for r in ordered])[:-1]]).tolist()
    assert tf.token_files(empty, queries.tokenizer_path()).count() == 0


def test_token_files_with_added_tokens(spark):
    rows = [(i, t) for i, t in enumerate(SPECIAL)] + [(50, "plain words here")]
    got = sorted(tf.token_files(frame(spark, rows), queries.tokenizer_path(), shards=2).collect(), key=lambda r: r.doc_id)
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in library_ids([t for _, t in rows])]
    assert library_ids(["x <|endoftext|> y"])[0] == [87, 220, 50256, 331, 0]


def test_permutation():
    for n in (1, 2, 3, 17, 64, 65, 1000):
        p = sm.permuted(np.arange(n), n, 99)
        assert sorted(p) == list(range(n)) and (sm.permuted(p, n, 99, back=True) == np.arange(n)).all()


def targets_by_force(sizes, weights, total, repeat):
    """Shares of total by weight; what is above `repeat` times a size is shared again until none is above."""
    out, rest, free = [0.0] * len(sizes), total, list(range(len(sizes)))
    while free:
        unit = rest / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > repeat * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(repeat * sizes[i])
            rest -= out[i]
        free = [i for i in free if i not in full]
    return out


def test_targets(spark):
    r = random.Random(5)
    for sizes in ([100, 100, 100], [10, 1000], [0, 0], [7], [r.choice([0, 3, 50, 4000]) * r.randrange(9) for _ in range(60)]):
        names = [f"s{k:03}" for k in range(len(sizes))]
        frame_ = spark.createDataFrame(list(zip(names, sizes, strict=True)), "skey string, size long")
        got = sm.source_plan(frame_, sm.MixConfig()).orderBy("source").collect()
        want = targets_by_force(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))], 1.5 * sum(sizes), 2)
        assert [x.skey for x in got] == names and [x.source for x in got] == list(range(len(sizes)))
        assert [x.target for x in got] == pytest.approx(want)
    assert sm.source_plan(frame_.limit(0), sm.MixConfig()).count() == 0


def slots_by_force(plan, config):
    """(shard, source, slot) and the block of every slot: a loop over shards, source by source."""
    total = sum(p.slots for p in plan)
    used, out = Counter(), {}
    grouped = defaultdict(list)
    for p in sorted(plan, key=lambda p: p.source):
        if p.slots:
            grouped[p.source // config.group].append(p)
    names = sorted(grouped)
    shares = np.array([sum(p.slots for p in grouped[g]) for g in names], float) / max(total, 1)
    shards = -(-total // config.shard_slots)

    def take(shard, p, n):
        for _ in range(n):
            j = used[p.source]
            if j < p.slots:
                epoch, within = divmod(j, p.blocks)
                order = sm.permuted(np.arange(p.blocks), p.blocks, sm._key(config.seed, p.source, epoch))
                out[p.source, j] = (shard, epoch, int(order[within]))
            used[p.source] += 1

    for shard in range(shards):
        counts = np.random.default_rng([config.seed, shard]).multinomial(config.shard_slots, shares)
        for g, n in zip(names, counts, strict=True):
            if n:
                own = np.array([p.slots for p in grouped[g]])
                for p, m in zip(grouped[g], np.random.default_rng([config.seed, shard, g]).multinomial(n, own / own.sum()), strict=True):
                    take(shard, p, int(m))
    for p in plan:
        take(shards, p, p.slots - min(p.slots, used[p.source]))
    return out


def test_slots_equal_a_loop(spark):
    rows = [(i, " ".join(words(i, r_ := 3 + 29 * (i % 7))), f"s{i % 11}" if i % 13 else None) for i in range(150)]
    assert r_
    config = sm.MixConfig(block=9, shard_slots=7, group=3)
    mixed = sm.mix(frame(spark, rows), config)
    got = {(x.source, x.slot): (x.shard, x.epoch, x.block) for x in mixed.slots.collect()}
    assert got == slots_by_force(mixed.plan.collect(), config)
    # every block of a source at most once in an epoch, and each word of the mix where the block lies
    assert len(set((k[0], v[1], v[2]) for k, v in got.items())) == len(got)
    laid = {(x.source, x.start): x for x in mixed.laid.where("size > 0").collect()}
    for x in mixed.parts.collect():
        shard, epoch, block = got[x.source, x.slot]
        assert (x.shard, x.epoch) == (shard, epoch) and laid[x.source, x.start].doc_id == x.doc_id
        assert block * 9 <= x.start + x.word and x.start + x.word + x.taken <= block * 9 + 9 and x.word + x.taken <= x.size


def test_more_sources_than_a_group(spark):
    rows = [(i, " ".join(words(i % 50, 1 + i % 40)), f"host{i % 700:04}") for i in range(2000)]
    config = sm.MixConfig(block=5, shard_slots=16, group=64)
    report = sm.mix_report(sm.mix(frame(spark, rows), config)).collect()
    source = {r[0]: r[2] for r in rows}
    taken, goal = Counter(), {}
    for r in report:
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
    assert len(goal) == 700 and all(abs(taken[k] - goal[k]) <= 1 for k in goal)


def check_mix(rows, weights=(5, 2, 1)):
    sizes, taken, goal = Counter(), Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        key = (r.source_size, r.target)
        sizes[key] += r.size
        taken[key] += r.taken
        goal[key] = r.target
    return all(abs(taken[k] - goal[k]) <= 1 * sum(1 for _ in [0]) for k in goal)


def test_mix(spark, sf):
    rows = queries.op5_source_mix(spark, sf).collect()
    docs = table(spark, sf, "documents").collect()
    assert Counter(r.doc_id for r in rows) == Counter(d.doc_id for d in docs)
    assert check_mix(rows)
    assert sorted(rows) == sorted(queries.op5_source_mix(spark, sf).collect())
    by = defaultdict(int)
    for d in docs:
        by[d.source] += len((d.text or "").encode().split())
    order = sorted(by, key=lambda s: s.encode())
    goals = targets_by_force([by[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(by.values()), 2)
    source, target = {d.doc_id: d.source for d in docs}, dict(zip(order, goals, strict=True))
    assert all(r.source_size == by[source[r.doc_id]] and r.target == pytest.approx(target[source[r.doc_id]]) for r in rows)


def test_mix_odd(spark, odd, empty):
    rows = sm.mix_report(sm.mix(odd, sm.MixConfig(block=7, shard_slots=5))).collect()
    assert len(rows) == odd.count() and check_mix(rows)
    assert sm.mix_report(sm.mix(empty)).count() == 0


def test_mixed_documents(spark):
    rows = [(i, " ".join(words(i, 5 + 37 * (i % 4))), "ab"[i % 2] if i % 5 else None) for i in range(40)]
    docs = frame(spark, rows)
    config = sm.MixConfig(block=11, shard_slots=4)
    report = {r.doc_id: r.taken for r in sm.mix_report(sm.mix(docs, config)).collect()}
    mixed = sm.mixed_documents(docs, config)
    got, texts = Counter(), dict((r[0], r[1]) for r in rows)
    for r in mixed.collect():
        got[r.doc_id] += len(r.text.split())
        assert all(part in texts[r.doc_id] for part in r.text.split("\n")) and r.n_chars == len(r.text)
    assert mixed.columns == docs.columns and got == Counter({k: v for k, v in report.items() if v})


def test_mixed_documents_odd(spark, odd, empty):
    config = sm.MixConfig(block=7, shard_slots=5)
    taken = sum(r.taken for r in sm.mix_report(sm.mix(odd, config)).collect())
    mixed = sm.mixed_documents(odd, config)
    assert mixed.columns == odd.columns and sum(len(r.text.split()) for r in mixed.collect()) == taken
    assert sm.mixed_documents(empty).count() == 0


CLASHES = ["size", "n", "spans", "epoch", "twin", "d", "t", "k", "row", "part", "tie", "text_id", "label", "rule", "start", "block", "a.b"]


def clashing(docs):
    """docs with columns of the names that operators use inside."""
    return docs.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES))


def test_mixed_documents_clash(spark):
    rows = [(i // 2, " ".join(words(i // 2, 5 + 37 * (i % 4))), "ab"[i % 2] if i % 5 else None) for i in range(40)] + [(3, "same text", "a"), (3, "same text", "b"), (3, "same text", "b")]
    docs = frame(spark, rows)
    config = sm.MixConfig(block=11, shard_slots=4)
    plain = sorted((r.doc_id, r.text, r.source or "") for r in sm.mixed_documents(docs, config).collect())
    mixed = sm.mixed_documents(clashing(docs), config)
    assert mixed.columns == [*docs.columns, *CLASHES]
    got = mixed.collect()
    assert sorted((r.doc_id, r.text, r.source or "") for r in got) == plain
    assert all(r[c] == f"own {c}" for r in got for c in CLASHES)


def classes_by_force(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            where[x].add(i)
    for i, s in sets.items():
        for j in set().union(*(where[x] for x in s)) if s else ():
            if j < i and len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in texts}


def test_near_duplicates(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = {r.doc_id: r.class_id for r in queries.op8_near_dedup(spark, sf).collect()}
    assert got == classes_by_force(texts)


def test_near_duplicates_group(spark):
    """One base with many almost-copies, of which some are too far from it and are linked by others only."""
    base, r, rows = words(7, 120, 3000), random.Random(1), []
    for i in range(150):
        w = list(base)
        for _ in range(i % 7):
            w[r.randrange(120)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    chain = words(8, 100, 3000)
    for i in range(150, 158):  # each is near its neighbours only
        chain = [f"y{i}", f"z{i}", *chain[:-2]]
        rows.append((i, " ".join(chain)))
    docs = frame(spark, rows)
    want = classes_by_force(dict(rows))
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()} == want
    kept = nd.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns


def test_near_duplicates_that_repeat_lines(spark):
    """Copies that repeat the same line a different number of times, some with a few other words besides."""
    rows = []
    for i in range(12):
        body, line, r = words(i + 60, 90, 3000), words(i + 80, 20, 3000), random.Random(i)
        rows.append((2 * i, " ".join(body + line * 2)))
        for _ in range(i % 3):
            body[r.randrange(90)] = f"x{r.randrange(10**6)}"
        rows.append((2 * i + 1, " ".join(body + line * (1000 if i % 2 else 60))))
    want = classes_by_force(dict(rows))
    assert len(set(want.values())) == 12
    docs = frame(spark, rows)
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()} == want
    assert sorted(r.doc_id for r in nd.drop_near_duplicates(docs).collect()) == sorted(set(want.values()))


def test_near_duplicates_odd(spark, odd, empty):
    rows = nd.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.class_id == r.doc_id for r in rows if r.doc_id != 5)
    assert nd.drop_near_duplicates(odd).count() == odd.count() - 1  # the row that is there twice
    assert nd.near_duplicates(empty).count() == 0 and nd.drop_near_duplicates(empty).count() == 0


def test_near_duplicates_without_words(spark):
    docs = frame(spark, [(4, ""), (2, ""), (3, " \n"), (2, ""), (5, " \n"), (6, None), (7, None), (None, ""), (8, "one two")])
    got = sorted((r.doc_id or 0, r.class_id) for r in nd.near_duplicates(docs).collect())
    assert got == [(0, 2), (2, 2), (2, 2), (3, 3), (4, 2), (5, 3), (6, 6), (7, 7), (8, 8)]
    assert sorted(r.doc_id for r in nd.drop_near_duplicates(docs).collect()) == [2, 3, 6, 7, 8]


def test_signature_estimates_similarity():
    r = np.random.default_rng(0)
    common, a, b = (r.integers(1, 2**62, 300).astype(np.uint64) for _ in range(3))
    x, y = np.sort(np.concatenate([common, a[:100]])), np.sort(np.concatenate([common, b[:100]]))
    values, owner = np.concatenate([x, y]), np.repeat([0, 1], 400)
    sig = nd.prob_minhash(values, owner, np.ones(800), 2, 2000, 5)
    assert abs((sig[0] == sig[1]).mean() - 300 / 500) < 0.05
    # weights: the chance of an element is its share
    values = np.array([1, 2], np.uint64)
    sig = nd.prob_minhash(values, np.zeros(2, int), np.array([3.0, 1.0]), 1, 4000, 5)
    assert abs((sig[0] == 1).mean() - 0.75) < 0.04


def test_wand_is_exact():
    items = [(i, " ".join(words(i, 20 + i % 9, 150))) for i in range(60)]
    for threshold in (0.3, 0.5, 0.7):
        index = dc.Index(items, dc.LeakConfig(threshold=threshold))
        for seed in range(200, 230):
            query = sorted({index.vocab[t] for t in words(seed, 40, 150) + items[seed - 200][1].split()[: seed % 20] if t in index.vocab})
            scores = Counter()
            p = index.postings
            for t in query:
                for i, v in zip(p.item[p.at[t] : p.at[t + 1]], p.impact[p.at[t] : p.at[t + 1]], strict=True):
                    scores[int(i)] += float(v)
            assert {i for i, _ in index.wand(query)} == {i for i, v in scores.items() if v >= threshold - 1e-6}


def test_leaks(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    items = {r.item_id: r.text for r in table(spark, sf, "benchmark").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.op9_decontaminate(spark, sf).collect()}
    held = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert held and held <= got and len(got - held) <= 2


def bm25_by_force(items, config):
    """Normalised impacts of each item's terms: text-book BM25, divided by the item's own score."""
    bags = {i: Counter(ts) for i, t in items if (ts := dc.terms(t))}
    mean, df = sum(b.total() for b in bags.values()) / len(bags), Counter(t for b in bags.values() for t in b)
    out = {}
    for i, b in bags.items():
        raw = {t: np.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * f * (config.k1 + 1) / (f + config.k1 * (1 - config.b + config.b * b.total() / mean)) for t, f in b.items()}
        out[i] = {t: v / sum(raw.values()) for t, v in raw.items()}
    return out


def leaks_by_force(texts, items, config):
    """Every passage against every item, without an index.  (text, item) to the best score."""
    impacts, index = bm25_by_force(items, config), dc.Index(items, config)
    place = {i: k for k, (i, _) in enumerate(index.items)}
    longest = max(len(t.split()) for _, t in items)
    window = max(config.min_window, 2 * longest)
    out = {}
    for d, text in texts:
        ts = [dc.term(w) for w in (text or "").split()]
        starts = range(0, max(1, len(ts) - window // 2), window // 2) if len(ts) > window else [0]
        for at in starts:
            have = set(ts[at : at + window])
            around = [t for t in ts[max(0, at - window // 8) : at + window + window // 8] if t]
            for i, own in impacts.items():
                score = sum(v for t, v in own.items() if t in have)
                if score >= config.threshold and index.held(place[i], *index.overlaps(place[i], around)):
                    out[d, i] = max(out.get((d, i), 0), score)
    return out


def test_leaks_equal_brute_force(spark):
    """Scores and hits of all passages against all items, in one index and in many; equal items are there twice."""
    r = random.Random(12)
    items = [(i, " ".join(words(i, 12 + i % 30, 300)) + ". " + " ".join(words(i + 500, 1 + i % 6, 300)) + ".") for i in range(120)]
    items += [(200, items[3][1]), (201, items[3][1]), (202, None), (203, " ")]
    texts = []
    for d in range(60):
        w = words(d + 700, r.randrange(20, 300), 300)
        for _ in range(r.randrange(3)):
            i, item = items[r.randrange(120)][0], items[r.randrange(120)][1].split()
            item[r.randrange(len(item))] = f"q{i}"
            at = r.randrange(len(w))
            w[at:at] = item
        texts.append((d, " ".join(w)))
    config = dc.LeakConfig()
    want = leaks_by_force(texts, [x for x in items if x[1] and x[1].strip()], config)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for slab_bytes in (1 << 20, 2000):
        got = {(x.doc_id, x.item_id): x.score for x in dc.leaks(frame(spark, texts), benchmark, dc.LeakConfig(slab_bytes=slab_bytes)).collect()}
        assert got.keys() == want.keys() and len(got) > 20
        assert all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_leaks_of_a_large_benchmark():
    """50,000 items: those in the texts are found, and the index is sparse."""
    bank = words(9, 60_000, 20_000)
    r = random.Random(2)
    items = [(i, " ".join(r.choices(bank, k=25)) + ". " + " ".join(r.choices(bank, k=4)) + ".") for i in range(50_000)]
    index = dc.Index(items, dc.LeakConfig())
    p = index.postings
    assert sum(x.nbytes for x in (p.item, p.impact, p.at, p.blocks, p.block_at, p.block_max, index.coarse, index.coarse_max, index.coarse_at)) < 64 << 20
    planted = r.sample(range(50_000), 60)
    texts = [" ".join([*r.choices(bank, k=150), items[i][1], *r.choices(bank, k=90)]) for i in planted] + [" ".join(r.choices(bank, k=300)) for _ in range(40)]
    found = {(x[0], x[1]) for x in dc.find_in_batch(list(range(100)), pa.array(texts), index)}
    assert found == set(enumerate(planted))


def test_leaks_with_few_words_changed():
    """Items of 20 words or more, answers of 1 to 9, in a longer text: one to three words changed, dropped or inserted."""
    items = [(i, " ".join(words(i, 19 + i, 5000)) + ". " + " ".join(words(i + 500, 1 + i % 9, 5000)) + ".") for i in range(40)]
    index, r = dc.Index(items, dc.LeakConfig()), random.Random(4)
    texts, wanted = [], []
    for i, text in items:
        n = len(text.split())
        edited = [(kind, [at]) for kind in ("change", "drop", "insert") for at in range(n)]
        edited += [(kind, r.sample(range(n), k)) for kind in ("change", "drop", "insert") for k in (2, 3) for _ in range(3)]
        for kind, places in edited:
            w = text.split()
            for at in sorted(places, reverse=True):
                w[at : at + (kind != "insert")] = [f"q{r.randrange(10**6)}"] * (kind != "drop")
            texts.append(" ".join([*words(i + 900, r.randrange(90), 60), *w, *words(i + 901, 40, 60)]))
            wanted.append(i)
    found = {(k, item) for k, item, *_ in dc.find_in_batch(list(range(len(texts))), pa.array(texts), index)}
    assert [(k, i) for k, i in enumerate(wanted) if (k, i) not in found] == []
    # the same words in another order, the question with another answer, and unrelated words aren't the item
    other = []
    for i, text in items:
        w, (asked, answer) = text.split(), text.split(". ")
        r.shuffle(w)
        other += [" ".join(w), " ".join(words(i + 3000, 100, 5000))] + ([asked + " no such answer"] if len(answer.split()) > 3 else [])
    assert dc.find_in_batch(list(range(len(other))), pa.array(other), index) == []


def test_leaks_odd(spark, odd, empty):
    item = " ".join(words(50, 30, 3000)) + ". " + " ".join(words(51, 8, 3000)) + "."
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one. two")], "item_id long, text string")
    long_text = " ".join(words(52, 5000, 3000)) + " " + item.upper() + " " + " ".join(words(53, 3000, 3000))
    docs = frame(spark, [(7, long_text), (8, item.split(".")[0]), (None, "q " + item + " r")])
    assert {(r.doc_id, r.item_id) for r in dc.leaks(docs, benchmark).collect()} == {(7, 1), (None, 1)}
    slabs = dc.leaks(docs, benchmark, dc.LeakConfig(slab_bytes=60)).collect()
    assert sorted(slabs, key=str) == sorted(dc.leaks(docs, benchmark).collect(), key=str)
    clean = dc.without_leaks(docs, benchmark)
    assert [r.doc_id for r in clean.collect()] == [8] and clean.columns == docs.columns
    assert dc.leaks(empty, benchmark).count() == 0 and dc.leaks(docs, benchmark.limit(0)).count() == 0
    assert dc.without_leaks(odd, benchmark.limit(0)).count() == odd.count()


def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "benchmark decontamination", "source mixing", "token files"]
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    seen = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen, sf).cache()
        rows = out.collect()
        if k < 4:
            assert out.columns == docs.columns
        if k == 0:
            gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in rows}
            assert gone and np.mean([labels[d] for d in gone if d in labels]) < 0.1
        if k == 1:
            before = {r.doc_id: r.text for r in seen.collect()}
            assert {r.doc_id for r in rows} == set(classes_by_force(before).values())
        if k == 3:
            assert sum(len(r.text.encode().split()) for r in rows) == pytest.approx(1.5 * sum(len(r.text.encode().split()) for r in seen.collect()), abs=40)
        if k == 4:
            mixed = seen.select("text").collect()
            assert len(rows) == len(mixed) and sum(r.n_tokens for r in rows) == sum(map(len, library_ids([r.text for r in mixed])))
        seen = out


def run_stages(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        docs = out.cache()
        docs.count()
    return docs, corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)


def test_pipeline_odd(spark, sf, odd, empty):
    """Null, empty, blank, long, repeated and clashing rows go through all stages; empty tables stay empty."""
    rows = [(100 + i, " ".join(words(i, 60 + i, 3000)) + ".", "ab"[i % 2]) for i in range(12)]
    docs = clashing(odd.unionByName(frame(spark, rows)))
    mixed, tokens = run_stages(spark, docs, sf)
    kept = mixed.collect()
    assert kept and all(r[c] == f"own {c}" for r in kept for c in CLASHES) and all(r.text.split() for r in kept)
    got = tokens.collect()
    assert len(got) == len(kept) and sum(r.n_tokens for r in got) == sum(map(len, library_ids([r.text for r in kept])))
    none, tokens = run_stages(spark, clashing(empty), sf)
    assert none.count() == 0 and tokens.count() == 0


def test_stages_carry_other_columns(spark, sf):
    """Each filtering stage returns rows of its input as they are."""
    docs = clashing(table(spark, sf, "documents")).cache()
    plain = {r.doc_id for r in nd.drop_near_duplicates(table(spark, sf, "documents")).collect()}
    kept = corpus_pipeline.near_duplicates(spark, docs, sf).collect()
    assert {r.doc_id for r in kept} == plain and all(r[c] == f"own {c}" for r in kept for c in CLASHES)
    for stage in (corpus_pipeline.quality, corpus_pipeline.decontamination):
        some = stage(spark, docs, sf)
        assert some.columns == docs.columns and some.exceptAll(docs).isEmpty() and not some.isEmpty()


def test_near_duplicates_with_a_long_tail(spark):
    """Bases of 60 words, and each again with a phrase of five words repeated a thousand times: sets at 0.86 all linked."""
    rows = []
    for i in range(60):
        base, phrase = words(i + 300, 60, 4000), words(i + 900, 5, 4000)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + phrase * 1000))]
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(frame(spark, rows)).collect()}
    assert got == classes_by_force(dict(rows)) and all(got[2 * i + 1] == 2 * i for i in range(60))


def test_near_duplicates_of_a_hub(spark):
    """More copies of one text than a task takes of a key: the hub's pairs are dealt over several."""
    r, base, rows = random.Random(4), words(70, 60, 5000), []
    for i in range(1400):
        w = list(base)
        w[r.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = {x.class_id for x in nd.near_duplicates(frame(spark, rows)).collect()}
    assert got == {0}
