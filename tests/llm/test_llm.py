"""Training-data operators against brute force, round trips and odd inputs."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spindrel.llm import balltree, chat, fmindex, graph, linededup, mixing, multiindex, nearcopies, packing, pfp, repeats, simhash, toxicity

DOCS = "doc_id long, text string, source string, lang string, n_chars long, fp long, label int, th long, id long, w string, key long"


def frame(spark, rows):
    """Documents with columns whose names operators use inside as well; repeated rows and nulls included by the callers."""
    return spark.createDataFrame([(*r, "en", 1, 7, 1, 2, 3, "x", 4) for r in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = ["\n".join(line(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    passage = line(90)
    texts += [line(20) + " " + passage + " " + line(rng.randint(5, 30)) for _ in range(6)]
    texts += texts[:5] + [texts[7].replace("a", "A", 1), texts[8] + " more", texts[9].upper(), "\t" + texts[10]]
    texts += [None, "", " \n ", "one", "one two", "one two", line(9000), (passage + " ") * 3, "aaaa" * 500]
    rows = [(i, t, None if i % 9 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, texts[2], "s1"), (None, None, None)]


def components(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_golay_code_is_perfect():
    code = simhash.Golay()
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000)
    flips = np.array([(1 << a) ^ (1 << b) if a != b else 0 for a, b in rng.integers(0, 23, (3000, 2))])
    near, other = code.near(words, 23), code.near(words ^ flips, 23)
    assert all(set(a) & set(b) for a, b in zip(near.tolist(), other.tolist(), strict=True))
    assert {len(set(a)) for a in near.tolist()} == {1, 6}


@pytest.mark.parametrize("paired", [48, 1])
def test_simhash(spark, corpus, paired):
    def slow(text):
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    want = {t: slow(t) for _, t, _ in corpus}
    prints = sorted(set(want.values()))
    label = components([(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2], prints)
    lowest = {}
    for i, t, _ in corpus:
        if i is not None:
            lowest[label[want[t]]] = min(i, lowest.get(label[want[t]], i))
    got = sorted((r["doc_id"] is None, r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.simhash_groups(frame(spark, corpus), paired=paired).collect())
    assert got == sorted((i is None, i, want[t], lowest.get(label[want[t]])) for i, t, _ in corpus)


def near_copies():
    """Texts of 40 to 300 words, each with copies of 1 to 12 words changed and other line breaks, a chain of them and a family of many."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]

    def edited(words, n):
        words = list(words)
        for at in rng.sample(range(len(words)), n):
            words[at] = rng.choice(vocabulary)
        return words

    def broken(words):
        every = rng.randint(5, 30)
        return "\n".join(" ".join(words[i : i + every]) for i in range(0, len(words), every))

    texts = []
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(40 + 260 * (i % 3) // 2)]
        texts += [broken(edited(base, n)) for n in (0, 1, rng.randint(2, 5), rng.randint(6, 12))]
    link = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(12):
        link = edited(link, 2)
        texts.append(broken(link))
    family = [rng.choice(vocabulary) for _ in range(150)]
    texts += [broken(edited(family, rng.randint(0, 6))) for _ in range(70)]
    rng.shuffle(texts)
    return texts


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_labels(texts):
    """Each text's component by brute force: fingerprints at most 2 bits apart, or Jaccard similarity of five-word shingles of 0.8 or more."""
    prints, sets = [simhash.fingerprint(t, 5) for t in texts], [sets_of(t) for t in texts]
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) if sets[a] and sets[b] else False
    pairs = [(a, b) for a in range(len(texts)) for b in range(a)]
    return components([(a, b) for a, b in pairs if (prints[a] ^ prints[b]).bit_count() <= 2 or alike(a, b)], range(len(texts)))


def test_near_copies_stage(spark, corpus):
    """The pipeline's stage against brute force over all pairs: copies of a similarity of 0.8 or more go, other line breaks or not."""
    import corpus_pipeline

    texts = near_copies() + [t for i, t, _ in corpus if i is not None]
    texts += [t.replace("\n", "  \t").upper() for t in texts[:10]]
    label = near_labels(texts)
    assert sum(label[i] != i for i in label) > 120
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == set(label.values())


def test_near_copies_with_null_and_repeated_ids(spark):
    """One row of each group stays, also where ids are null or belong to different texts."""
    import corpus_pipeline

    rng = random.Random(13)
    one, two, three = (" ".join(f"w{rng.randint(0, 5000)}" for _ in range(80)) for _ in range(3))
    near = lambda t, n: t + f" x{n}"
    rows = [(None, one), (None, near(one, 1)), (5, near(one, 2)), (None, two), (None, near(two, 1)), (7, near(two, 2)), (5, near(two, 3)), (None, three), (None, near(three, 1)), (5, near(one, 2)), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    of_three = {k: n for k, n in got.items() if k[1] and k[1].startswith(three)}
    assert {k: n for k, n in got.items() if k not in of_three} == {(5, near(one, 2)): 1, (5, near(two, 3)): 1, (9, None): 1}
    assert list(of_three.values()) == [1] and next(iter(of_three))[0] is None


def test_minhash_reaches_the_similarity():
    """Pairs at 0.8 to 0.85 share a band and pass the sketch, nearly all."""
    rng = np.random.default_rng(3)
    hit = total = 0
    for _ in range(400):
        n = int(rng.integers(60, 600))
        same, one, two = (rng.integers(0, 1 << 64, k, dtype=np.uint64) for k in (n, n // 10, n // 10))
        low, other = nearcopies.minima(np.concatenate([same, one])), nearcopies.minima(np.concatenate([same, two]))
        equal = (low == other)[: nearcopies.BANDS * nearcopies.ROWS].reshape(nearcopies.BANDS, nearcopies.ROWS)
        hit += bool(equal.all(1).any())
        total += 1
    assert hit >= 0.995 * total


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1200)]
    want = components(edges, {x for e in edges for x in e if e[0] != e[1]})
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if n in got} and set(got) == {x for a, b in edges if a != b for x in (a, b)}


def brute_repeats(sequences, length):
    count = Counter(s[i : i + length] for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        spans = []
        for i in range(len(s) - length + 1):
            if count[s[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out.append([tuple(x) for x in spans])
    return out


@pytest.mark.parametrize("hot,chunk", [(2000, 400_000), (0, 400_000), (3, 700)])
def test_byte_dedup(spark, corpus, hot, chunk, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    raw = [(t or "").encode() for _, t, _ in corpus]
    want = brute_repeats(raw, 100)
    got = pfp.dedup(frame(spark, corpus), window=100, hot=hot).collect()
    key = lambda i, n, spans, kept: (i is None, i or 0, n, tuple(spans), bytes(kept))
    wanted = []
    for (i, _, _), s, spans in zip(corpus, raw, want, strict=True):
        gone = {p for a, b in spans for p in range(a, b)}
        wanted.append(key(i, len(s), spans, bytes(c for p, c in enumerate(s) if p not in gone)))
    assert sorted(key(r["doc_id"], r["n_bytes"], [tuple(x) for x in r["removed"]], r["kept"]) for r in got) == sorted(wanted)


@pytest.mark.parametrize("hot", [2000, 0])
def test_word_dedup(spark, corpus, hot):
    words = [tuple((t or "").encode().split()) for _, t, _ in corpus]
    want = brute_repeats(words, 12)
    got = fmindex.dedup(frame(spark, corpus), window=12, hot=hot).collect()
    wanted = []
    for (i, _, _), s, spans in zip(corpus, words, want, strict=True):
        gone = {p for a, b in spans for p in range(a, b)}
        wanted.append((i is None, i or 0, len(s), tuple(spans), b" ".join(w for p, w in enumerate(s) if p not in gone).decode()))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], tuple(tuple(x) for x in r["removed"]), r["kept"]) for r in got) == sorted(wanted)


def test_corpus_order_of_the_parse():
    rng = random.Random(1)
    for alphabet in (b"ab", b"abcdefgh"):
        texts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(12)]
        texts += [texts[0] + texts[1], texts[2][5:]]
        parse = pfp.Parse(texts, trigger=3, every=4)
        rest, after = parse.key(np.arange(sum(map(len, texts))))
        whole, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        suffixes = [whole[i : ends[owner[i]]] for i in np.lexsort((after, rest))]
        assert suffixes == sorted(suffixes)


def test_fm_index_counts():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 5, n) for n in (40, 60, 50)]
    text = np.concatenate([np.append(p + 3, i) for i, p in enumerate(parts)])
    index = fmindex.FMIndex(text, 61)
    for _ in range(50):
        pattern = rng.integers(3, 8, rng.integers(1, 5))
        low, high = np.array([0]), np.array([len(text)])
        for c in pattern[::-1]:
            low, high = index.step(np.array([c]), low), index.step(np.array([c]), high)
        want = sum(text[i : i + len(pattern)].tolist() == pattern.tolist() for i in range(len(text)))
        assert max(0, int(high[0] - low[0])) == want


def test_line_dedup(spark, corpus):
    rows = []
    for i, t, _ in corpus:
        if t is not None:
            th = t
            rows += [((i is not None, i or 0, th, n), frozenset(s.lower().split())) for n, s in enumerate(t.split("\n"))]
    hashes = {r["text"]: r["h"] for r in spark.createDataFrame([(t,) for _, t, _ in corpus if t is not None], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    lines = sorted({((a, i, hashes[th], n), s) for (a, i, th, n), s in rows if s}, key=lambda x: x[0])
    gone = set()
    for k, (at, s) in enumerate(lines):
        if any(len(s & o) * 9 >= (len(s) + len(o)) * 4 for _, o in lines[:k]):
            gone.add(at)
    want = []
    for i, t, _ in corpus:
        mine = [] if t is None else [n for n, s in enumerate(t.split("\n")) if (i is not None, i or 0, hashes[t], n) in gone]
        size = 0 if t is None else sum(bool(s.split()) for s in t.split("\n"))
        want.append((i is None, i or 0, size, len(mine), tuple(mine)))
    got = linededup.per_document(frame(spark, corpus)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_lines"], r["n_removed"], tuple(r["removed"])) for r in got) == sorted(want)
    texts = linededup.dedup(frame(spark, corpus))
    assert texts.columns == [*frame(spark, []).columns, "n_removed"]
    for r in texts.where("doc_id IS NOT NULL").collect():
        source = next(t for i, t, _ in corpus if i == r["doc_id"])
        cut = {n for a, i, _, n in gone if a and i == r["doc_id"]}
        assert r["text"] == (None if source is None else "\n".join(s for n, s in enumerate(source.split("\n")) if n not in cut))


def test_mixing(spark, corpus):
    rows = mixing.mix(frame(spark, corpus)).collect()
    assert len(rows) == len(corpus)
    size = lambda t: len((t or "").encode().split())
    total = {}
    for _, t, s in corpus:
        total[s] = total.get(s, 0) + size(t)
    order = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, rest, open_ = {}, float(sum(total.values())), set(order)
    while True:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * total[s]}
        if not full:
            break
        for s in full:
            target[s] = 3.0 * total[s]
            rest -= target[s]
        open_ -= full
    target |= {s: weight[s] * level for s in open_}
    taken = Counter()
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == total[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    largest = max(size(t) for _, t, _ in corpus)
    assert all(abs(taken[s] - target[s]) <= largest for s in order)
    again = mixing.mix(frame(spark, corpus).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_packing(spark, corpus):
    from tokenizers import Tokenizer
    import public_tokenizers

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = [(900, "x<|endoftext|>y"), (901, "你好 \U0001f600 \x1c\x85    á"), (902, "".join(map(chr, range(1, 0x370))))]
    rows = [*corpus, *((i, t, "s") for i, t in odd)]
    ids = lambda t: [*exact.encode(t or "", add_special_tokens=False).ids, 1]
    got = packing.pack(frame(spark, rows).coalesce(2), window=256).collect()
    parts, sequences = {}, {}
    for r in got:
        parts.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_tokens"]))
    pieces = Counter()
    for i, t, _ in rows:
        want = ids(t)
        pieces[i] += len(want)
        if i is not None and i != 3:
            assert [x for _, p, _ in sorted(parts[i]) for x in p] == want and {n for *_, n in parts[i]} == {len(want)}
    assert {i: sum(len(p) for _, p, _ in ps) for i, ps in parts.items()} == pieces
    padded = 0
    for s in sequences.values():
        at = 0
        for offset, length, total in sorted(s):
            assert offset == at
            at += length
        assert at == s[0][2] <= 256
        padded += 0 if at & (at - 1) == 0 else 256 - at
    assert padded == 0
    with pytest.raises(ValueError):
        packing.pack(frame(spark, rows), window=100)


def test_nnls_meets_a_histogram():
    lengths = np.array([100, 156, 56, 200])
    combos = packing.combinations(lengths, np.array([30, 10, 10, 5]), 256, 100)
    assert sorted(sorted(x for x in r if x <= 256) for r in combos.tolist()) == [[56, 100, 100], [56, 200], [100, 156]]
    histogram = np.zeros(257)
    histogram[lengths] = [30, 10, 15, 5]
    x = dict(zip([tuple(sorted(r)) for r in combos.tolist()], packing.nnls(combos, histogram, 3000), strict=True))
    assert x[100, 156, 257] == pytest.approx(10, abs=0.1) and x[56, 100, 100] == pytest.approx(10, abs=0.1) and x[56, 200, 257] == pytest.approx(5, abs=0.1)


def test_chat_round_trip(spark):
    rng = random.Random(5)
    pool = ["hi", "", "\\", "a\\b", "<s>[INST]x[/INST]y</s>", "</s>", "<|endoftext|>", "é😀 \n\n", "[/INST]" * 3, "<<SYS>>", "<\\s>"]
    turns = []
    for conv in range(60):
        for t in range(rng.randint(1, 6)):
            turns.append((conv, t, ("user", "assistant")[t % 2] if conv % 7 else rng.choice(["tool\n", "[INST]", ""]), pool[0] if t == 0 and conv % 3 else rng.choice(pool), "extra"))
    turns += [(70, 0, None, None, "e"), (70, 0, None, None, "e"), (None, 1, "assistant", "z", "e"), (None, None, "user", "w", "e"), (71, 0, "assistant", "long " * 30000, "e")]
    turns += [(72, t, "user", f"t{t}", "e") for t in range(80)] + [(73, t, "user", f"t{t}", "e") for t in range(80)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, position string")
    packed = chat.format_chats(df, tree_tokens=500).cache()
    back = {r["conv_id"]: r for r in chat.read_back(packed).collect()}
    convs = {}
    for c, t, role, text, _ in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    assert set(back) == set(convs)
    for c, want in convs.items():
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == want
        assert "".join(back[c]["learned"]) == "".join(t for r, t in want if r == "assistant")
    nodes = packed.where("position IS NOT NULL").count()
    assert nodes < sum(map(len, convs.values()))
    for r in packed.where("position IS NOT NULL").collect():
        assert r["position"] == sum(a["stop"] - a["start"] for a in r["attends"]) and len(r["loss"]) * 4 == len(r["ids"])
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def vectors_of(spark, n=300, dim=8):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=dim).tolist()) for i in range(n)]
    rows += [(n + i, rows[5][1]) for i in range(40)]
    bad = [(9000, None), (9050, [None] * dim), (9100, [float("nan")] * dim), (9150, [float("inf")] * dim), (None, rows[0][1]), (9200, []), (9250, [0.0] * dim), (9300, [1.0, 2.0])]
    return spark.createDataFrame([(a, b, 1, 2) for a, b in [*rows, *bad, rows[7]]], "vec_id long, embedding array<double>, shard int, score int"), [*rows, rows[7], (9250, [0.0] * dim)]


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(balltree, "TREE_ROWS", 64)
    monkeypatch.setattr(balltree, "LEAF", 8)
    df, rows = vectors_of(spark)
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = []
    for q, v in {i: v for i, v in ints if i % 50 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ints if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = sorted(map(tuple, balltree.top_k(df, 50, 5).collect()))
    assert got == sorted(want)
    assert balltree.top_k(df.limit(0), 50, 5).count() == 0
    assert balltree.top_k(df.where("vec_id IN (0, 1)"), 50, 5).count() == 1


def test_inverted_multi_index(spark):
    df, rows = vectors_of(spark)
    rows = [r for r in rows if any(r[1])]
    got = {}
    for r in multiindex.neighbours(df, 20, 10, codes=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hit = total = 0
    for q, v in {i: v for i, v in rows if i % 20 == 0}.items():
        best = sorted((-float((np.array(v) * np.array(w)).sum()), i) for i, w in rows if i != q)[:10]
        hit += len({i for _, i in best} & {i for i, _ in got[q]})
        total += 10
        assert all(a[1] > b[1] or (a[1] == b[1] and a[0] <= b[0]) for a, b in zip(got[q], got[q][1:], strict=False))
        assert len(got[q]) == 10 and q not in [i for i, _ in got[q]]
    assert hit >= 0.9 * total
    full = multiindex.neighbours(df, 20, 10, visit=1.0, codes=16)
    assert full.count() == len(got) * 10
    assert multiindex.neighbours(df.limit(0), 20, 10).count() == 0


def test_cell_walk_is_in_order():
    rng = np.random.default_rng(8)
    a, b, sizes = rng.normal(size=6), rng.normal(size=9), rng.integers(0, 4, (6, 9))
    cells = multiindex.walk(a, b, sizes, 10**9)
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums, reverse=True) and len(cells) == int((sizes > 0).sum())
    some = multiindex.walk(a, b, sizes, 10)
    assert some == cells[: len(some)] and sum(sizes[c] for c in some) >= 10 > sum(sizes[c] for c in some[:-1])


def test_gradients():
    """Back-propagation through both networks against finite differences."""
    texts = [["ab", "cde", "f"], ["cde", "xyzzy"], ["ab"]]
    model = toxicity.train([" ".join(t) for t in texts], [1, 0, 0], epochs=(1,))
    labels = np.array([1, 0, 1], dtype=np.float32)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    class Keep:
        def update(self, p, grads):
            self.grads = {k: v.copy() for k, v in grads.items()}

    keep = Keep()
    model.learn(texts, labels, keep)
    rng = np.random.default_rng(0)
    for name in ("cf.w", "cb.u", "cf.v", "wf.w", "wb.u", "wf.v", "att.w", "out.w", "char", "wb.b"):
        where = np.unravel_index(np.abs(keep.grads[name]).argmax(), keep.grads[name].shape)
        for spot in {where, tuple(rng.integers(0, s) if name != "char" else w for s, w in zip(keep.grads[name].shape, where, strict=True))}:
            old, losses = model.p[name][spot], []
            for step in (1e-3, -1e-3):
                model.p[name][spot] = old + step
                losses.append(model.learn(texts, labels, Keep()))
            model.p[name][spot] = old
            assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(keep.grads[name][spot], rel=0.05, abs=2e-4)


def test_toxicity(spark):
    rng = random.Random(3)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    rows, labels = [], []
    for i in range(700):
        words = [rng.choice(plain) for _ in range(rng.randint(1, 120))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words) + 1), "zork" + rng.choice(plain))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(bad)))
    docs = frame(spark, [*rows, (800, None, "s"), (801, "", "s"), (802, "quiet words " * 60000 + "zorkab zorkcd", "s"), (None, "x", "s"), rows[0]])
    table = spark.createDataFrame([*labels, (None, 1, 1), (900, None, None), labels[0]], "doc_id long, quality int, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, table))
    assert scored.columns == [*docs.columns, "toxicity"]
    got = [(r["doc_id"], r["toxicity"]) for r in scored.select("doc_id", "toxicity").collect()]
    assert len(got) == docs.count() and all(0 <= s <= 1 for _, s in got)
    held = [(s >= 0.5) == (i % 4 == 0) for i, s in got if i is not None and i < 700 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(held) >= 0.95
    by = dict(got)
    assert by[800] < 0.5 and by[801] < 0.5 and by[802] >= 0.5
    assert toxicity.score(docs.limit(0), toxicity.train([], [])).count() == 0


def test_windows_cover_every_word():
    for n in range(1, 200):
        spans = toxicity.windows_of(n)
        assert {i for a, b in spans for i in range(a, b)} == set(range(n)) and all(b - a <= toxicity.WINDOW for a, b in spans)
    assert "".join(toxicity.words_of("ab " + "x" * 100)) == "ab" + "x" * 100


def test_empty_tables(spark):
    none = frame(spark, [])
    for found in (simhash.simhash_groups(none), pfp.dedup(none), fmindex.dedup(none), packing.pack(none), mixing.mix(none), linededup.per_document(none), linededup.dedup(none)):
        assert found.count() == 0
    blank = frame(spark, [(1, None, None), (2, "", None)])
    for found in (simhash.simhash_groups(blank), pfp.dedup(blank), fmindex.dedup(blank), packing.pack(blank), mixing.mix(blank), linededup.per_document(blank), linededup.dedup(blank)):
        assert found.count() == 2


def test_pipeline(spark, tmp_path):
    """Every stage on a small corpus against plain Python where that can say what must come out."""
    import corpus_pipeline

    rng = random.Random(8)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    text = lambda: "\n".join(" ".join(rng.choice(plain) for _ in range(14)) for _ in range(6))
    rows = [(i, text(), "en", f"s{i % 4}", 1) for i in range(200)]
    rows = [(i, t + "\nzork" + rng.choice(plain) + " zork" + rng.choice(plain) if i % 5 == 0 else t, a, b, c) for i, t, a, b, c in rows]
    rows += [(300, rows[1][1], "en", "s1", 1), (301, rows[2][1].replace("a", "o", 1), "en", "s2", 1), (302, None, None, None, None), (303, "", "en", None, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1], str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/stage{k}"))
        assert k == 4 or tuple(kept[-1].columns) == corpus_pipeline.COLUMNS
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    clean = {i for i in ids[0] if i >= 300 or i % 5}
    assert len(ids[1] & clean) >= 0.97 * len(clean) and len(ids[1] - clean) <= 2
    assert ids[2] == ids[1] - {300, 301}
    assert ids[3] == ids[2] - {303} and kept[3].count() == len(ids[3])
    sizes = {r["doc_id"]: r["text"] for r in kept[3].collect()}
    copies = Counter(r["doc_id"] for r in kept[4].select("doc_id").collect())
    assert max(copies.values()) <= 3 and set(copies) <= set(sizes)
    assert kept[5].where("start = 0").count() == sum(copies.values())
    assert kept[5].agg(F.sum("length")).first()[0] == sum(len(packing.Encoder()(sizes[i] or "")) * n + n for i, n in copies.items())


def test_line_dedup_near_the_threshold(spark):
    """Lines of 1 to 60 words and variants of them around a similarity of 0.8, all against all; copies of one line in great number, too."""
    rng = random.Random(8)
    vocabulary = [f"w{int(rng.paretovariate(0.4)) % 3000}" for _ in range(4000)]
    lines = []
    for _ in range(160):
        base = list(dict.fromkeys(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))))
        lines.append(base)
        for _ in range(rng.choice([1, 2, 3, 14])):
            kept = [w for w in base if rng.random() > rng.choice([0.02, 0.1, 0.2])]
            lines.append(kept + [rng.choice(vocabulary) for _ in range(rng.randint(0, max(1, len(base) // 6)))] or ["x"])
    order = list(range(len(lines)))
    rng.shuffle(order)
    rows = [(i, "\n".join(" ".join(lines[j]) for j in order[at : at + 3]), "s") for i, at in enumerate(range(0, len(order), 3))]
    flat = [((i, n), frozenset(s.split())) for i, t, _ in rows for n, s in enumerate(t.split("\n")) if s.split()]
    want = {at for k, (at, s) in enumerate(flat) if any(len(s & o) * 9 >= (len(s) + len(o)) * 4 for _, o in flat[:k])}
    got = {(r["doc_id"], n) for r in linededup.per_document(frame(spark, rows)).collect() for n in r["removed"]}
    assert got == want and 100 < len(want) < len(flat) - 100


def test_line_dedup_with_clashing_names(spark):
    rows = [(1, "a b c d e\nf g", 1, 2, 3, 4, 5, 6, 7, 8, 9.5), (2, "f g\na b c d e", 1, 2, 3, 4, 5, 6, 7, 8, 9.5), (3, None, 1, 2, 3, 4, 5, 6, 7, 8, 9.5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_lines int, _id int, _gone int, _th int, d int, none int, `row` int, lines int, `a.b` double")
    done = linededup.dedup(docs)
    assert done.columns == [*docs.columns, "n_removed"] and done.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert sorted(tuple(r) for r in done.collect()) == sorted([(*rows[0], 0), (2, "", *rows[1][2:], 2), (*rows[2], 0)])


def test_training_does_not_depend_on_the_process():
    import os
    import subprocess
    import sys

    code = """
import random
import re
from spindrel.llm import toxicity
rng = random.Random(1)
words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 6))) for _ in range(120)]
texts = [" ".join([rng.choice(words) for _ in range(rng.randint(1, 60))] + ["zork"] * (i % 3 == 0)) for i in range(90)]
model = toxicity.train(texts, [int(i % 3 == 0) for i in range(90)], epochs=(1, 1))
print(repr(model.shift), [repr(float(x)) for x in model.score([t.split() for t in texts[:9]])])
"""
    said = {subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONHASHSEED": str(seed), "OMP_NUM_THREADS": "1"}, capture_output=True, text=True, check=True).stdout for seed in (0, 1)}
    assert len(said) == 1


def test_conflicting_labels_count_as_toxic(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: seen.extend(zip(texts, labels, strict=True)))
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(1, 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i in range(1, 9) for y in ((0, 1) if i % 2 else (0,))] + [(2, None), (None, 1)], "doc_id long, toxic int")
    toxicity.fit(docs, labels)
    assert sorted(seen) == sorted((f"t{i}", i % 2) for i in range(1, 9) if zlib.crc32(str(i).encode()) % 5)


def test_neighbours_of_vectors_of_one_component(spark):
    rows = [(i, [float(i)]) for i in range(1, 41)] + [(41, [9.0, 9.0]), (42, [0.0])]
    got = [tuple(r) for r in multiindex.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 2).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 40, 800.0), (20, 2, 39, 780.0), (40, 1, 39, 1560.0), (40, 2, 38, 1520.0)]


def test_production_windows_on_the_test_data(spark):
    """The operators of bytes and words at 400 and 35, on all documents of the smallest tables."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    for run, length, split in ((pfp.dedup, 400, lambda t: t), (fmindex.dedup, 35, lambda t: tuple(t.split()))):
        want = brute_repeats([split(t) for _, t in texts], length)
        got = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in run(docs).collect()}
        assert got == {i: spans for (i, _), spans in zip(texts, want, strict=True)} and any(want)


def test_training_memory_is_bounded():
    """Windows are laid out in blocks, and n-grams of clean documents are only counted where toxic ones hold them."""
    model = toxicity.train(["a b c d", "zork b"] * 20, [0, 1] * 20)
    texts = [["a", "b"] * (toxicity.WINDOW // 2)] * 100_000
    tracemalloc.start()
    whole = model.score(texts)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert most < 75 and np.allclose(whole, model.score(texts[:1])[0], atol=1e-5)
    clean = [[f"w{i}x{j}" for j in range(50)] for i in range(1_000)]
    toxic = [["zork", "plain"]] * 1_000
    tracemalloc.start()
    odds = toxicity.evidence(clean + toxic, np.array([0] * 1_000 + [1] * 1_000))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert most < 5 and "^zork$" in odds and "^w1x" not in odds


def test_rarity_is_short_in_the_plan(spark):
    words = spark.range(300_000).select(F.concat(F.lit("w"), "id").alias("said"), F.lit(3).cast("long").alias("times"))
    levels = linededup.rarity(words)
    assert len(levels._jc.toString()) < 4 * linededup.BUCKETS
    assert spark.range(1).select(F.array_max(levels)).first()[0] > 4


def test_line_dedup_counts_some_files(spark, corpus, monkeypatch):
    """The same lines go, whichever words count as rare, and only a part of a large table's files is read for that."""
    docs, read = frame(spark, corpus), []
    result = lambda: sorted(map(repr, linededup.per_document(docs).collect()))
    want, whole = result(), linededup.rarity
    monkeypatch.setattr(linededup, "COUNTED", 2)
    monkeypatch.setattr(linededup, "rarity", lambda texts, each=1: read.append((each, len(texts.inputFiles()))) or whole(texts, each))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result() == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert read[0][0] == linededup.EACH and read[0][1] > 1


def test_line_dedup_does_no_more_than_it_must(spark):
    """A line has as many keys as missed words can break and one, its words are ordered once, and all keys are sorted by one number."""
    texts = spark.createDataFrame([(n, n, 0, 1, " ".join(f"w{j}" for j in range(n))) for n in range(1, 60)], "r long, o long, often long, times long, said string")
    met = linededup.meetings(texts, linededup.rarity(texts))
    got = {r["r"]: r["count"] for r in met.groupBy(linededup.number("p").alias("r")).count().collect()}
    broken = lambda n: max(2 * a + b for a in range(n) for b in range(n) if 4 * (a + b) <= n - a)
    assert got == {n: 1 if n < linededup.SHORTEST else broken(n) + 1 for n in range(1, 60)}
    plan = linededup.shared_keys(met, linededup.SIMILARITY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("sort_array(") == 1 and len(re.findall(r"Sort \[key#\d+L ASC NULLS FIRST\],", plan)) == 1
    said = ["", " ", "\t", " \x0b\x0c\r ", "!", "a", " \t.", "\x0b\x01", "\x1f", " ", " é", "\r "]
    got = spark.createDataFrame([(s,) for s in said], "said string").select("said", linededup.has_words(F.col("said")).alias("has")).collect()
    assert {r["said"]: r["has"] for r in got} == {s: bool(s.strip(linededup.BLANKS)) for s in said}
