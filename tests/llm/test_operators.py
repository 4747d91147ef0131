"""Every operator against a plain version on a small corpus, and on an empty table."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from bidloom.llm import components, decontaminate, lm_score, mixing, near_dup, quality, repeats, secret_scan, token_count, token_file, url_filter
from bidloom.llm.catalog import vocabulary
from bidloom.session import scratch_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text, k):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components_of(rows, k):
    sets = {i: shingle_set(t, k) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            shared = len(sets[x] & sets[y])
            if x < y and shared and 100 * shared >= 80 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_groups(corpus, k):
    docs, rows = corpus
    want = components_of(rows, k)
    got = near_dup.near_groups(docs, shingle=k).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    kept = near_dup.keep_one(docs, shingle=k)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def family(copies, seed=3):
    """Copies of one text with 0 to 14 changed words of 110, so that many pairs lie close to the threshold, and some at a second text."""
    rng, rows = random.Random(seed), []
    bases = [[f"w{rng.randrange(10**6)}" for _ in range(110)] for _ in range(2)]
    for i in range(copies):
        words_ = list(bases[i % 9 == 0])
        for at in rng.sample(range(110), rng.randrange(15)):
            words_[at] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words_[: rng.choice((110, 110, 95))])))
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_groups_around_the_threshold(spark, k):
    rows = family(260)
    want = components_of(rows, k)
    got = near_dup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=k).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_prefix_pairs_hold_every_link(spark):
    """All links of seekers are among the pairs, whatever the components are."""
    rng = np.random.default_rng(5)
    base = rng.integers(1, 1 << 62, 120)
    sets = {}
    for i in range(150):
        own = base.copy()
        own[rng.choice(120, rng.integers(0, 25), replace=False)] = rng.integers(1, 300, 1)[0] + np.arange(1)
        sets[i] = np.unique(np.concatenate([own[: rng.integers(100, 121)], rng.integers(1, 200, 3)]))
    frame = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in sets.items()], "set_id long, grp long, members array<long>")
    owned = spark.createDataFrame([(i, i % 2, i if i > 30 else i % 2) for i in sets], "set_id long, grp long, root long")
    root = {i: i if i > 30 else i % 2 for i in sets}
    pairs = {(r["a"], r["b"]) for r in near_dup.prefix_pairs(near_dup.prefixes(frame, 80), owned, 80).collect()}
    links = set()
    for a in sets:
        for b in range(a + 2, 150, 2):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if root[a] != root[b] and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                links.add((a, b))
    assert links and links <= pairs


def test_posterior_bounds():
    floor = near_dup.least_matches(0.8)
    assert len(floor) == 9 and (np.diff(floor) > 0).all()
    assert floor[-1] < 0.8 * 288


@pytest.mark.parametrize("local", [0, 1 << 18])
def test_connected(spark, local):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7), (200, 100)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long"), local).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 200: 100, 300: 100}


@pytest.mark.parametrize("local", [0, 1 << 18])
def test_extended(spark, local):
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    rng = random.Random(9)
    first = [(rng.randrange(60), rng.randrange(60)) for _ in range(25)]
    more = [(rng.randrange(60), rng.randrange(60)) for _ in range(20)] + [(3, 3)]
    roots = components.connected(frame(first), local)
    for new in (more, [], [(70, 71)]):
        roots, first = components.extended(roots, frame(new), local), first + new
        nodes, least = components.least_nodes(*np.array(first).T)
        want = {int(n): int(r) for n, r in zip(nodes, least) if n != r}
        got = [tuple(r) for r in roots.collect()]
        assert dict(got) == want and len(got) == len(want)


def test_least_nodes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 30, 400):
        a, b = rng.integers(-50, 300, (2, n))
        parent = {x: x for x in {*a.tolist(), *b.tolist()}}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            parent[max(find(x), find(y))] = min(find(x), find(y))
        nodes, least = components.least_nodes(a, b)
        assert dict(zip(nodes.tolist(), least.tolist())) == {x: find(x) for x in parent}


def test_repeats(corpus):
    docs, rows = corpus
    seen = defaultdict(set)
    for at, (i, t, *_) in enumerate(rows):
        w = words(lower(t))
        for p in range(len(w) - 49):
            seen[tuple(w[p : p + 50])].add((at, p))
    want = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for at, p in places:
                want[rows[at][0]].update(range(p, p + 50))
    got = defaultdict(set)
    for r in repeats.find_repeats(docs).collect():
        got[r["doc_id"]].update(range(r["begin"], r["end"]))
        assert r["end"] - r["begin"] >= 50
    assert {i: s for i, s in got.items()} == {i: s for i, s in want.items()}


def test_repeats_of_suffixes_apart_in_both_orders(spark):
    """A family of copies with scattered edits: some pairs share 50 words around a place while other copies stand between them."""
    rng, rows = random.Random(11), []
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    for i in range(3000):
        rows.append((i, " ".join(f"x{rng.randrange(10**6)}" if rng.random() < 1 / 25 else w for w in base)))
    seen = defaultdict(set)
    for i, t in rows:
        w = t.split()
        for p in range(len(w) - 49):
            seen[tuple(w[p : p + 50])].add((i, p))
    want = {(i, q) for places in seen.values() if len(places) > 1 for i, p in places for q in range(p, p + 50)}
    found = repeats.find_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {(r["doc_id"], q) for r in found for q in range(r["begin"], r["end"])} == want


def test_leaks(spark, corpus):
    docs, rows = corpus
    item = " ".join(rows[40][1].split()[:15])
    edited = item[:20] + "#" + item[21:50] + item[52:]
    bench = spark.createDataFrame([(1, item.upper()), (2, edited), (3, "not here at all, certainly " * 3), (4, None), (5, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got[(40, 1)] == 0 and got[(40, 2)] == 3
    assert {i for i, _ in got} == {40}
    assert decontaminate.find_leaks(docs, bench, block_chars=60).count() == len(got)
    assert {r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()} == {r[0] for r in rows} - {40}


def test_myers_against_table():
    rng = np.random.default_rng(5)
    for _ in range(400):
        p, t = ("".join(rng.choice(list("abc"), n)) for n in (rng.integers(1, 9), rng.integers(0, 15)))
        previous = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            current = [i]
            for j, b in enumerate(t, 1):
                current.append(min(previous[j] + 1, current[-1] + 1, previous[j - 1] + (a != b)))
            previous = current
        assert decontaminate.myers(p, t) == (min(previous), previous.index(min(previous)))


def test_quality(corpus):
    docs, rows = corpus
    got = quality.judge(docs).select("doc.doc_id", "doc.n_words", *[f"`{c}`" for c in quality.COUNTS if c != "n_words"], "base_failed", "kept").collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    counts = {r["doc"]["doc_id"]: r for r in quality.with_counts(docs).collect()}
    for i, text in texts.items():
        w, body, r = words(text), text or "", counts[i]
        lines = [x for x in body.split("\n") if words(x)]
        windows = Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4))
        covered = {q for p in range(len(w) - 4) if windows[tuple(w[p : p + 5])] > 1 for q in range(p, p + 5)}
        assert (r["n_words"], r["word_chars"]) == (len(w), sum(map(len, w)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in body)
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == len(covered), i
    for r in got:
        w = words(texts[r["doc_id"]])
        assert r["base_failed"] == (len(w) < 10 or 5 * counts[r["doc_id"]]["n_repeat_words"] > len(w))
        assert not (r["base_failed"] and r["kept"])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def test_estimate_finds_the_accuracies():
    rng = np.random.default_rng(1)
    accuracy = [0.95, 0.9, 0.8, 0.7, 0.85, 0.6, 0.9, 0.75]
    patterns = Counter()
    for _ in range(4000):
        good = rng.random() < 0.7
        code = 0
        for j, a in enumerate(accuracy):
            vote = 0 if rng.random() < 0.3 else (1 if good else -1) * (1 if rng.random() < a else -1)
            code += (vote + 1) * 3**j
        patterns[code] += 1
    found, prior = quality.estimate(patterns)
    assert max(abs(a - b) for a, b in zip(found, accuracy)) < 0.06 and abs(prior - 0.7) < 0.05


def test_secrets(corpus):
    docs, rows = corpus
    got = secret_scan.scan_secrets(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, *_ in rows if i == r["doc_id"]) or ""
        spans = []
        assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
        spans += [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
        base = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == k for x in spans) for k in range(3)]
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def test_urls(spark):
    pages = [(1, "https://A.example.NET/en/x?q=1"), (2, "http://example.net/de/"), (3, None), (4, "no url"), (5, "x://org/fr/#a"), (6, "x://b.org/frx"), (7, "x://net"), (8, "x://example.com/de/")]
    pages += [(100 + i, f"http://bad.example.org/free/{i}") for i in range(20)] + [(200 + i, f"http://fine.example.org/read/{i}") for i in range(20)]
    labels = [(100 + i, 0, 0) for i in range(19)] + [(119, 1, None), (119, 1, None)] + [(200 + i, 1, 0) for i in range(20)]
    frame = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'x' AS host", "0 AS bad", "1 AS rule")
    got = {r["page_id"]: r for r in url_filter.judge_urls(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == len(pages)
    named = {i: (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(1, 9)}
    assert named == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"),
        2: ("example.net", "/de/", "net/", "block"),
        3: ("", "", None, "allow"),
        4: ("", "", None, "allow"),
        5: ("org", "/fr/", "org/fr/", "allow"),
        6: ("b.org", "/frx", None, "allow"),
        7: ("net", "", None, "allow"),
        8: ("example.com", "/de/", "example.com/de/", "block"),
    }
    assert all(got[100 + i]["verdict"] == "block" and got[200 + i]["verdict"] == "allow" for i in range(20))
    assert all({"h:bad", "p:free"} & set(got[100 + i]["mined_rule"].split()) for i in range(20))
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert url_filter.judge_urls(frame, empty).count() == len(pages)


def test_mixing(corpus):
    docs, rows = corpus
    got = mixing.mix_rates(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    for r in got:
        s = r["doc"]["source"]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], target[s], rel_tol=1e-12)
        assert r["copies"] in (math.floor(target[s] / sizes[s]), math.ceil(target[s] / sizes[s]))
    assert Counter(r["doc_id"] for r in mixing.mix(docs).collect()) == Counter({r["doc"]["doc_id"]: 0 for r in got}) + Counter(
        x for r in got for x in [r["doc"]["doc_id"]] * r["copies"]
    )


def test_token_file(spark, corpus):
    from tokenizers import Tokenizer

    docs, rows = corpus
    path = scratch_dir(spark, "tokens")
    token_file.write_tokens(docs, vocabulary("byte_bpe_50k.json"), path, segment_tokens=2000)
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    start, want = 0, []
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_file.read_tokens(spark, path).collect()) == want
    segment = spark.read.parquet(path).first()
    ids = token_file.dac_decode(segment["levels"], segment["bitmaps"])
    for i in range(0, len(ids), 37):
        assert token_file.dac_get(segment["levels"], segment["bitmaps"], segment["ranks"], i) == ids[i]


def test_codes_of_all_widths():
    rng = np.random.default_rng(3)
    ids = rng.choice(np.array([0, 1, 255, 256, 65535, 65536, 2**31, 2**32 - 1], np.uint64), 5000)
    codes = token_file.dac_encode(ids)
    assert len(codes[0]) == 4 and (token_file.dac_decode(*codes[:2]) == ids).all()
    assert all(token_file.dac_get(*codes, i) == ids[i] for i in range(len(ids)))


def test_token_counts(corpus):
    docs, rows = corpus
    path = vocabulary("piece_bpe_32k.model")
    sp, stable = token_count.model(path)
    assert stable
    texts = {r[0]: r[1] or "" for r in rows}
    for r in token_count.count_tokens(docs, path, chunk=900).collect():
        text = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(sp.encode(text)))
        assert r["over_limit"] == (r["n_tokens"] > 4096)
    odd = "x" * 3000 + "  \n " + "ab▁ c" * 200 + " " * 700 + "é ü 日本 " * 100
    for chunk, overlap in ((50, 3), (200, 10), (1000, 2000)):
        assert token_count.count_spliced(sp, odd, chunk, overlap) == len(sp.encode(odd))


def test_lm_scores(corpus):
    docs, rows = corpus
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10]
    counts = Counter(w for r in train for w in [*words(lower(r[1])), None])
    n, v = sum(counts.values()), len(counts)
    got = lm_score.score_documents(docs, contexts=64).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        tokens = [*words(lower(texts[r["doc_id"]])), None]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert (r["n_tokens"], r["train_tokens"]) == (len(tokens), n)
        assert r["n_known"] == sum(counts[t] > 0 for t in tokens), r
        assert math.isclose(r["base_score"], sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens), rel_tol=1e-9)
        assert r["score"] < 0 and 0 < r["bits_per_byte"] < 12


def context_tree_chance(train, contexts, text):
    """Plain context-tree weighting with the same kept contexts: chance of ``text`` by walking the tree for every bit."""
    data = [b"\0\0\0" + (t or "").encode() + b"\0" for t in train]
    grams = Counter(d[i : i + 4] for d in data for i in range(len(d) - 3))
    total = sum(grams.values())
    kept = {b""}
    for d in (1, 2, 3):
        sums = Counter()
        for g, n in grams.items():
            sums[g[3 - d : 3]] += n
        kept |= {c for c, n in sums.items() if n * contexts >= total}

    def path(context):
        nodes = [c for c in (context[3 - d :] if d else b"" for d in range(4)) if c in kept]
        return nodes if len(nodes) == 4 else [*nodes, ("rest", nodes[-1])]

    a = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    for g, n in grams.items():
        nodes = path(g[:3])
        for up, down in zip(nodes, nodes[1:]):
            children[up].add(down)
        for k in range(8):
            for node in nodes:
                a[node, k, g[3] >> (8 - k)][g[3] >> (7 - k) & 1] += n
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    def weighted(node, k, prefix):
        own = kt(*a[node, k, prefix]) if (node, k, prefix) in a else 0.0
        if not children[node]:
            return own
        return np.logaddexp(own, sum(weighted(c, k, prefix) for c in sorted(children[node], key=str))) - math.log(2)

    score, data = 0.0, b"\0\0\0" + text.encode() + b"\0"
    for i in range(3, len(data)):
        nodes, byte = path(data[i - 3 : i]), data[i]
        for k in range(8):
            prefix, bit = byte >> (8 - k), byte >> (7 - k) & 1
            chance = None
            for node in reversed(nodes):
                z, o = a[node, k, prefix] if (node, k, prefix) in a else (0, 0)
                estimate = ((o if bit else z) + 0.5) / (z + o + 1)
                if chance is None:
                    chance = estimate
                else:
                    w = math.exp(kt(z, o) - math.log(2) - weighted(node, k, prefix))
                    chance = w * estimate + (1 - w) * chance
            score += math.log10(chance)
    return score


def test_context_tree_weighting(spark):
    train = ["abracadabra", "abba", "", None, "cabal é"]
    rows = [(i, t) for i, t in zip((1, 2, 3, 4, 7), train)]
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 10] + [(held, "abrabz")]
    used = [t for i, t in rows if i != held]
    got = {r["doc_id"]: r["score"] for r in lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), contexts=8).collect()}
    for i, t in rows:
        assert math.isclose(got[i], context_tree_chance(used, 8, t or ""), rel_tol=1e-4), (i, t)


def test_rare_contexts_keep_their_counts(spark):
    """Contexts seen few times among many bytes, down to the last depth: the scores are those of the tree with every context."""
    rng = random.Random(2)
    used = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 10]
    train = ["".join(rng.choice("abcdefgh") for _ in range(600)) + " xq zj" for _ in used]
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [*zip(used, train), (held, "abc xq zj \u00e9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (1 << 20, 50):
        got = {r["doc_id"]: r["score"] for r in lm_score.score_documents(docs, share=share, depth=3).collect()}
        for i, t in (rows[0], rows[-1]):
            assert math.isclose(got[i], context_tree_chance(train, 1 << 40, t), rel_tol=1e-6), (i, share)
    base = ["wabcx", "yabcz"] * 40
    deep = spark.createDataFrame([*zip(used, base), (held, "wabcx")], "doc_id long, text string")
    short, whole = ({r["doc_id"]: r["score"] for r in lm_score.score_documents(deep, depth=d).collect()}[held] for d in (3, 4))
    assert whole > short + 0.2


def test_empty_tables(spark, nothing):
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string")
    path = scratch_dir(spark, "tokens")
    token_file.write_tokens(nothing, vocabulary("byte_bpe_50k.json"), path)
    for frame in (
        url_filter.judge_urls(pages, labels),
        secret_scan.scan_secrets(nothing),
        repeats.find_repeats(nothing),
        near_dup.near_groups(nothing),
        lm_score.score_documents(nothing),
        decontaminate.find_leaks(nothing, bench),
        quality.judge(nothing),
        token_file.read_tokens(spark, path),
        mixing.mix(nothing),
        token_count.count_tokens(nothing, vocabulary("piece_bpe_32k.model")),
    ):
        assert frame.count() == 0
