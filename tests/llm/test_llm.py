"""The training-data operators against brute force, on small fixtures with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import zlib
from bisect import bisect_right
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import public_tokenizers as P
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from ticklattice.llm import queries as q
from ticklattice.llm._util import connected_components, read
from ticklattice.llm.bpe_codec import bpe_codec, bpe_decode, load_ranks, stitch
from ticklattice.llm.decontam import matches
from ticklattice.llm.html_text import extract_html, main_text
from ticklattice.llm.id_records import PATTERN, IdEncoder, doubtful, frame, frames, new_output, read_index, read_records, write_id_records
from ticklattice.llm.licenses import TEMPLATES, anchors, bands_for, normal_words, scan_licenses, seed
from ticklattice.llm.quality import features, fit_quality, score_quality
from ticklattice.llm.simhash import BKForest, BKTree, block_masks, keep_distinct, near_duplicates
from ticklattice.llm.token_counts import load_tokenizer, safe_pieces, token_counts
from ticklattice.llm.toxicity import ToxicityModel, fit_toxicity, score_toxicity, segments
from ticklattice.llm.winnow import edited_likeness

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
LONG = " ".join(f"word{i % 977} and it's" for i in range(30000))
TEXTS = [None, "", " ", "a", "Hello  world\n\n 12 don't", "Grüße, <|endoftext|> 日本語 ", LONG, "same text here", "same text here", "x" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "src", 1.0, True) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, Score string, fp double, n_tokens boolean")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_token_counts(docs, none):
    tok = load_tokenizer(open(JSON, "rb").read())
    got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, JSON).collect())
    want = [len(tok.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    assert got == sorted((len((t or "").encode()), n, n > 1024) for t, n in zip(TEXTS, want, strict=True))
    assert "".join(safe_pieces(LONG, 100)) == LONG and token_counts(none, JSON).count() == 0


def test_bpe_codec(docs, none):
    enc, pat = load_ranks(open(RANKS, "rb").read(), P.PATTERN)
    out = ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")
    got = [(r, t) for n in (1, 4) for r, t in zip(bpe_codec(docs, RANKS, P.PATTERN, output=out, chunk=64, overlap=16, threads=n).collect(), TEXTS, strict=True)]
    for r, t in got:
        ids = enc.encode_ordinary(t or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == (t or "").encode()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded).hexdigest()
    back = bpe_decode(bpe_codec(docs, RANKS, P.PATTERN, output=("ids",)), RANKS, P.PATTERN)
    assert all(r.decoded == (t or "").encode() for r, t in zip(back.collect(), TEXTS, strict=True))
    assert bpe_codec(none, RANKS, P.PATTERN).count() == 0
    rnd, pool = random.Random(1), ThreadPoolExecutor(3)
    for _ in range(400):
        t = "".join(rnd.choice(rnd.choice(["ab '1.\n  l", "a \n\t", "é1'sll're d"])) for _ in range(rnd.randrange(300)))
        c = stitch(pat, t, 16, 4)
        assert c == stitch(pat, t, 16, 4, pool)
        assert [i for a, b in zip(c, c[1:], strict=False) for i in enc.encode_ordinary(t[a:b])] == enc.encode_ordinary(t)


def test_bk_tree_and_masks():
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(40)]
    vals = list({b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(5))) & (2**64 - 1) for b in base for _ in range(6)})
    tree = BKTree(vals)
    for v in vals[:60]:
        assert sorted(tree.within(v, 3)) == [i for i, w in enumerate(vals) if (v ^ w).bit_count() <= 3]
    for n in (10, 10**7, 10**10):
        masks = block_masks(n, 3)
        for _ in range(200):
            x = sum(1 << i for i in rnd.sample(range(64), 3))
            assert any(not x & m for m in masks)


def brute_components(rows, linked):
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(rows[i], rows[j]):
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(rows))]


def test_near_duplicates(spark, sf, docs, none):
    def fp(t):
        w = (t or "").encode().lower().split()
        g = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        bits = sum((np.array([xxhash.xxh64_intdigest(x, 42) >> b & 1 for b in range(64)]) for x in g), np.zeros(64, int))
        return sum(1 << b for b in range(64) if 2 * bits[b] > len(g))

    few = read(spark, sf, "documents").select("doc_id", "text").unionByName(docs.where("length(text) < 100 or text is null").select(F.col("doc_id") + 10**6, "text").toDF("doc_id", "text"))
    rows = sorted(((r.doc_id, fp(r.text)) for r in few.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    comp = brute_components(rows, lambda x, y: (x[1] ^ y[1]).bit_count() <= 3)
    want = sorted((str(i), f"{f:016x}", rows[c][0]) for (i, f), c in zip(rows, comp, strict=True))
    for shard in (2048, 2):
        assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in near_duplicates(few, shard=shard).collect()) == want
    assert near_duplicates(none).count() == 0


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    pairs = {frozenset(e) for e in edges}
    comp = brute_components(nodes, lambda a, b: frozenset((a, b)) in pairs)
    assert got == {n: nodes[c] for n, c in zip(nodes, comp, strict=True)}


def test_keep_distinct(spark, docs, none):
    base = " ".join(f"w{i}" for i in range(300))
    near = base.replace("w150", "other")
    rows = [(5, base), (2, near), (9, base), (7, "quite another text of some words"), (None, base), (11, None), (12, ""), (7, "quite another text of some words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id for r in keep_distinct(df).collect()), key=str) == [11, 2, 7]
    assert keep_distinct(docs).columns == docs.columns and keep_distinct(none).count() == 0


def copies(rnd, base, edits):
    w = base.split()
    for at in rnd.sample(range(10, len(w) - 10), edits):
        w[at] = f"edit{rnd.random()}"
    return " ".join(w)


def brute_stay(rows, shingle=5, similarity=0.8):
    sets = [{tuple((t or "").lower().split()[i : i + shingle]) for i in range(max(1, len((t or "").split()) - shingle + 1))} for _, t in rows]
    comp = brute_components(list(range(len(rows))), lambda i, j: len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]))
    return sorted({c: min(i for (i, _), d in zip(rows, comp, strict=True) if d == c) for c in comp}.values())


def test_keep_distinct_links_stars_and_chains(spark):
    """Copies of one base that are like the base but not like each other, and texts each like only the next."""
    rnd, texts = random.Random(11), []
    for g in range(6):
        base = " ".join(f"g{g}w{i}" for i in range(300))
        texts += [base, *(copies(rnd, base, 4) for _ in range(12))]
    for g in range(4):
        t = " ".join(f"c{g}w{i}" for i in range(200))
        for _ in range(12):
            texts.append(t)
            t = copies(rnd, t, 3)
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute_stay(rows)
    for sample in (4096, 5):
        assert sorted(r.doc_id for r in keep_distinct(spark.createDataFrame(rows, "doc_id long, text string"), sample=sample).collect()) == want


def test_trees_of_many_shards_find_what_brute_force_finds():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (4, 30), np.uint64)
    prints = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 60, (4, 30)).astype(np.uint64)), base[:, :9], base[:, :9]], axis=1)
    shard = np.sort(rng.integers(0, 5, prints.shape[1]))
    forest = BKForest(prints, shard)
    asks = rng.permutation(prints.shape[1])
    for radius in (0, 4, 66, 256):
        got = {}
        for q, n, d in forest.within(prints[:, asks], np.append(shard[asks[:-1]], 9), np.full(len(asks), radius), at_once=50):
            got |= {(int(asks[i]), int(j)): int(k) for i, j, k in zip(q, n, d, strict=True)}
        d = np.bitwise_count(prints[:, :, None] ^ prints[:, None, :]).astype(int).sum(0)
        near = (d <= radius) & (shard[:, None] == shard[None, :])
        near[asks[-1]] = False  # its shard is not there
        assert got == {(i, j): d[i, j] for i, j in np.argwhere(near)}
    assert len(forest.nodes) == len(shard) - len(np.unique(shard))


def test_keep_distinct_searches_dealt_shards(spark):
    rnd = random.Random(8)
    rows = []
    for g in range(4):  # they share a passage, within a group most pairs are similar, between groups none
        line, own = [f"line{i}" for i in range(12)], [f"g{g}w{i}" for i in range(150)]
        for k in range(15):
            words = list(own)
            for i in rnd.sample(range(150), 1 + k % 2):
                words[i] = f"x{g}.{k}.{i}"
            rows.append((g * 100 + k, " ".join(line + words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_stay(rows)
    assert len(want) < len(rows) / 2
    for shard in (2, 5, 2048):
        assert sorted(r.doc_id for r in keep_distinct(df, shard=shard).collect()) == want


def test_keep_distinct_finds_every_pair_at_the_threshold(spark):
    """Pairs of all lengths, from just below to well above the similarity, with a passage that many texts share."""
    rnd, rows = random.Random(12), []
    common = " ".join(f"common{i}" for i in range(40))
    for n in (5, 6, 9, 14, 30, 60, 120, 400):
        for edits in range(1, 1 + max(1, n // 25)):
            for part in ("", common):
                base = " ".join(f"p{len(rows)}w{i}" for i in range(n))
                other = copies(rnd, base, edits) if n > 20 + edits else base + " more"
                rows += [(len(rows), f"{base} {part}"), (len(rows) + 1, f"{other} {part}")]
    assert sorted(r.doc_id for r in keep_distinct(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute_stay(rows)


def test_licenses(spark, docs, none):
    filler = " ".join(f"plain{i}" for i in range(60))
    rows = [(i, f"{filler}\n{t} {filler}") for i, t in enumerate(TEMPLATES.values())] + [(100, filler), (101, None), (102, "licensed under nothing"), (None, "All rights\nreserved.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def brute(text):
        w, out = normal_words(text or ""), set()
        for name, t in TEMPLATES.items():
            tw = normal_words(t)
            k = min(5, len(tw))
            need = {tuple(tw[i : i + k]) for i in range(len(tw) - k + 1)}
            size = 1 << max(2, (len(tw) - 1).bit_length())
            for a in range(len(w)):
                part = w[a : a + size]
                if len(need & {tuple(part[i : i + k]) for i in range(len(part) - k + 1)}) >= 0.8 * len(need):
                    out.add(name)
        return out

    got = {(r.doc_id, r.license_id) for r in scan_licenses(df).collect()}
    assert {(i, n) for i, t in rows for n in brute(t)} == got and all(anchors(TEMPLATES, 5, 0.8))
    assert scan_licenses(docs).count() == 0 and scan_licenses(none).count() == 0
    more = df.selectExpr("doc_id", "text", "1 as band", "2 as value", "3 as containment", "4 as w")
    assert {(r.doc_id, r.license_id) for r in scan_licenses(more).collect()} == got


def test_license_bands_retrieve_edited_texts(spark):
    """Every window function that the bound asks for is there, and texts with words exchanged are found as long as their
    containment holds."""
    assert len({seed(j) for j in range(5000)}) == 5000 and (1 - 0.129) ** bands_for(0.129) <= 1e-6
    rnd, rows = random.Random(3), []
    for name in ("mit-text", "bsd-2-clause-text", "isc-text"):
        ws = TEMPLATES[name].split()
        for edits in (1, 3, 5):
            w = list(ws)
            for at in rnd.sample(range(len(w)), edits):
                w[at] = f"other{at}"
            rows.append((len(rows), "intro words here " * 9 + " ".join(w) + " and more text" * 9, name))
    got = {(r.doc_id, r.license_id) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, name string")).collect()}
    shingles = lambda t: {tuple(normal_words(t)[i : i + 5]) for i in range(len(normal_words(t)) - 4)}
    want = {(i, n) for i, t, n in rows if len(shingles(t) & shingles(TEMPLATES[n])) >= 0.8 * len(shingles(TEMPLATES[n]))}
    assert want <= got and len(want) >= 6


def test_winnowing(spark, docs, none):
    rows = [(1, LONG[:4000]), (2, LONG[:4000]), (3, " ".join(f"z{i}" for i in range(200))), (None, None), (4, ""), (4, "tiny")]
    got = edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {(r.doc_id, r.n_chars): r for r in got}
    tie = {r.t: r.h for r in spark.createDataFrame([("",), ("tiny",)], "t string").selectExpr("t", "shiftrightunsigned(xxhash64(t), 1) h").collect()}
    order = [*sorted([(4, ""), (4, "tiny")], key=lambda r: tie[r[1]]), (3, rows[2][1]), (2, rows[1][1]), (1, rows[0][1]), (None, "")]
    for (i, t), (_, nxt) in zip(order, [*order[1:], order[0]], strict=True):
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert by[i, len(t)].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
    assert by[1, 4000].fingerprint == by[2, 4000].fingerprint and by[2, 4000].near_next == 1 and by[3, len(rows[2][1])].near_next == 0
    assert 0.2 < by[3, len(rows[2][1])].near_edited < 1
    assert edited_likeness(docs).count() == len(TEXTS) and edited_likeness(none).count() == 0


def word_hashes(spark, words):
    return {r.w: r.h for r in spark.createDataFrame([(w,) for w in sorted(set(words))], "w string").selectExpr("w", "xxhash64(w) h").collect()}


def brute_winnow(text, hash_of, k, window):
    """(hash, position) selected: hashes rolled word by word, the rightmost least of each window."""
    turn = lambda h, n: (h << n % 64 | h >> 64 - n % 64) & (2**64 - 1) if n % 64 else h
    u = [hash_of[w] & (2**64 - 1) for w in text.lower().split()]
    if not u:
        return []
    h, out = 0, []
    for i, x in enumerate(u):
        h = turn(h, 1) ^ x ^ (turn(u[i - k], k) if i >= k else 0)
        if i >= k - 1 or i == len(u) - 1:
            out.append(h >> 28)
    chosen = []
    for s in range(max(1, len(out) - window + 1)):
        i = min(range(s, min(s + window, len(out))), key=lambda j: (out[j], -j))
        if i not in chosen:
            chosen.append(i)
    return [(out[i], i) for i in chosen]


def test_winnow_selects_rightmost_least(spark):
    from ticklattice.llm.winnow import hashes, positions, winnow

    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("ab") for _ in range(n)) for n in (1, 2, 3, 4, 6, 7, 10, 150)] + [" ".join(f"w{rnd.randrange(50)}" for _ in range(90)), ""]
    h = word_hashes(spark, " ".join(texts).split())
    for k, window in ((3, 8), (3, 4), (2, 1), (5, 6)):
        for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", winnow(F.col("t"), k, window).alias("p")).select("t", hashes("p").alias("h"), positions("p").alias("i")).collect():
            assert list(zip(r.h, r.i, strict=True)) == brute_winnow(r.t, h, k, window), (r.t, k, window)


def test_likeness_equals_brute_force(spark, sf):
    """Likenesses of real documents, of an id and null ids that fill several ranges, and columns whose names are used inside."""
    rows = [(r.doc_id if i % 3 else (7 if i % 2 else None), r.text) for i, r in enumerate(read(spark, sf, "documents").limit(120).collect())]
    rows = [(i, None if k == 5 else t, 1, "x") for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int, packed string")
    got = edited_likeness(df).collect()
    tie = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t, *_ in rows], "t string").selectExpr("t", "shiftrightunsigned(xxhash64(t), 1) h").collect()}
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]], r[1]))
    want = []
    edits = [(t[: len(t) - len(t) // 2] + n[: len(t) // 2]) for (_, t), (_, n) in zip(order, [*order[1:], order[0]], strict=True)]
    h = word_hashes(spark, " ".join([t for _, t in order] + edits).lower().split())
    alike = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    of = lambda t: {x for x, _ in brute_winnow(t, h, 3, 4)}
    for (i, t), e, (_, n) in zip(order, edits, [*order[1:], order[0]], strict=True):
        want.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), round(alike(of(t), of(e)), 9), round(alike(of(t), of(n)), 9)))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)


def test_decontamination(spark, docs, none):
    item = "A train leaves Paris at 60 km per hour and reaches Rome after 12 hours so how far has it gone by then"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short one"), (1, item)], "item_id long, text string")
    swap = item.replace("Paris", "Oslo").replace("60", "75").replace("Rome", "Bern").replace("12", "9")
    mixed = item.replace("A train leaves", "My old car left").replace("Rome", "Paris")
    rows = [(1, f"Before this. {item} after"), (2, f"So. {swap}."), (3, "A train leaves home"), (4, None), (None, item), (5, "nothing of the kind " * 50), (6, mixed)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1 << 20, 40):
        got = {r.doc_id: r.leaks for r in matches(df, bench, block_bytes=size).collect()}
        assert {d for d, x in got.items() if x} == {1, 2, None, 6} and all(x.item_id == 1 for x in got[1])
        assert got[2][0].reparameterised and got[2][0].changed_slots == 4 and not got[1][0].reparameterised
    assert matches(docs, bench.limit(0)).where(F.size("leaks") > 0).count() == 0 and matches(none, bench).count() == 0


def test_decontamination_finds_verbatim_copies(spark):
    items = {
        1: "12 kg 7 lb 30 oz 5 g 9 m 11 km 4 ft 2 mi",
        2: "Anna Bert Carl Dora Emil Fritz Gerd Hans Ida",
        3: "What is the capital city of France?",
        4: "Consider this list\nWhat colour did the old house near Paris have then",
        5: "too short here",
    }
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = [(1, f"Listed are {items[1]} and so on"), (2, f"present were {items[2]} today"), (3, f"Question 3\n{items[3]}"), (4, items[4].replace("\n", " ")), (5, "Too short here"), (9, "not too short here")]
    rows += [(6, items[4].replace("near Paris", "near\nRome")), (7, "13 kg 8 lb 31 oz 6 g 10 m 12 km 5 ft 3 mi"), (8, "What is\nthe capital city of Spain?")]
    got = {r.doc_id: {x.item_id for x in r.leaks} for r in matches(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: {1}, 2: {2}, 3: {3}, 4: {4}, 5: {5}, 6: {4}, 7: set(), 8: {3}, 9: set()}


def brute_leaks(text, item, common, window=8, literal=4):
    """Whether the text holds a window of the item, by comparing every window of one with every window of the other."""
    import ticklattice.llm.decontam as d

    edge = lambda w: w.strip(d.EDGE)
    ws, vs = (text or "").split(), (item or "").split()
    n = min(window, len(vs))
    if n < 4:
        return bool(vs) and [edge(w).lower() for w in ws] == [edge(v).lower() for v in vs]

    def kinds(words, reading):
        out = []
        for i, w in enumerate(words):
            x, begins = edge(w), i == 0 or words[i - 1].rstrip("\"')]”»*#&|")[-1:] in tuple(".!?:")
            if x.lower() in d.NUMERALS or any(c.isdigit() for c in x) and not any(c.isalpha() for c in x):
                out.append(1)
            elif x.lower() in d.UNITS and (len(x) > 1 or x in "%$€£"):
                out.append(2)
            else:
                out.append(3 * (len(x) > 1 and x[0].isupper() and x[1:].islower() and (x.lower() not in common or reading and not begins)))
        return out

    w0, v0 = [edge(w).lower() for w in ws], [edge(v).lower() for v in vs]
    if any(w0[i : i + n] == v0[j : j + n] for i in range(len(ws) - n + 1) for j in range(len(vs) - n + 1)):
        return True
    for reading in (0, 1):
        a, b = kinds(ws, reading), kinds(vs, reading)
        for i in range(len(ws) - n + 1):
            for j in range(len(vs) - n + 1):
                k = b[j : j + n]
                if a[i : i + n] == k and k.count(0) >= min(literal, n - 1) and all(x == y for x, y, z in zip(w0[i : i + n], v0[j : j + n], k, strict=True) if not z):
                    pairs = {(z, y, x) for x, y, z in zip(w0[i : i + n], v0[j : j + n], k, strict=True) if z}
                    if len({p[:2] for p in pairs}) == len(pairs) == len({p[::2] for p in pairs}):
                        return True
    return False


def test_decontamination_equals_brute_force(spark, sf):
    """School-book questions under other names and numbers, at sentence starts and within, in mixed order, and real tables."""
    rnd = random.Random(10)
    names, things = ["Alice", "Bob", "Janet", "Omar", "Will", "Rosa"], ["apples", "eggs", "pens", "kg of flour"]
    forms = [
        "{a} has {x} {t}. {b} has {y} {t}. How many {t} do they have together?", "{a} sells {x} {t} and eats three", "So {a} sells {x} {t} and gives {b} {y} of them each day.",
        "If {a} buys {x} {t} for ${y} and {b} buys none, who paid more?", "What will {b} pay for {x} {t}?", "{a} and {b}", "Compute {x} + {y}",
    ]
    fill = lambda f: f.format(a=rnd.choice(names), b=rnd.choice(names), x=rnd.randrange(2, 90), y=rnd.randrange(2, 90), t=rnd.choice(things))
    items = [(i, fill(f)) for i, f in enumerate(forms)]
    texts = [fill(rnd.choice(forms)) for _ in range(60)] + [f"so {fill(rnd.choice(forms))} and then.\n{fill(rnd.choice(forms))}" for _ in range(60)] + [t for _, t in items]
    texts += [f"well {t[0].lower()}{t[1:]} indeed" for _, t in items] + [None, "", "and", "Alice and"]
    common = {x for _, t in items for w in t.split() if (x := w.strip(".,?$+")).islower()}
    got = {r.doc_id: {x.item_id for x in r.leaks} for r in matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {d: {i for i, v in items if brute_leaks(t, v, common)} for d, t in enumerate(texts)}
    assert {d: (texts[d], got[d], want[d]) for d in got if got[d] != want[d]} == {}
    assert sum(map(len, want.values())) > 70


def test_html(spark):
    page = '<html><body><nav><a>Menu</a></nav><div class="cookie-notice">We use cookies.</div><article><h1>T &amp; U</h1><p>One <b>two\n three<br>four<p>Five</article><aside>no</aside><div class="comments"><p>Nice!</div><footer>f</footer>'
    assert main_text(page) == "T & U\nOne two three four\nFive" and main_text("") == "" and main_text("<p>unfinished <b") == "unfinished"
    df = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "y"), (1, "u", page, "x")], "page_id long, url string, html string, Text string")
    assert [(r.text, r.n_chars) for r in extract_html(df).orderBy("page_id").collect()][-1] == ("", 0)
    assert extract_html(df.limit(0)).count() == 0


def test_html_surges_and_dives():
    """Pages without an article, of short text, with hostile scripts and quotes, with an article's own names, very long ones."""
    para = "This is a paragraph of the story that has a good number of words in it. "
    menu = "<table>" + "".join(f"<tr><td><b>Go {i}</b></td></tr>" for i in range(3)) + "</table>"
    page = f"<body>{menu}<div><div><div></div></div></div><div><h2>Title</h2><p>{para}</p><p>Short.</p><p>{para * 3}</p></div><div><div><div></div></div></div><table><tr><td>Imprint</td></tr></table></body>"
    assert main_text(page) == "\n".join(["Title", para.strip(), "Short.", (para * 3).strip()])
    assert main_text("<body><p>Short note.</p></body>") == "Short note." and main_text("just text") == "just text"
    assert main_text("<script>x=\"<i a='\"</script><p>don't stop > now</p>") == "don't stop > now"
    assert main_text("<p title=\"a > b\">one</p><p class='x>two</p>") == "one\ntwo"
    assert main_text("<article><section class='related-work'><p>A</p></section><div class='legal'>B</div><div class='share'>no</div><p>C</p></article>") == "A\nB\nC"
    assert main_text(f"<ul><li><a href=x>{para}</a></li></ul><div><div></div></div><p>{para}</p>") == para.strip()
    assert main_text("<article>" + "<p>x</p>" * 50_000 + "</article>").count("\n") == 49_999
    assert main_text("<p>" * 20_000 + "deep") == "deep"


def test_html_tables(spark, sf):
    import html
    import re

    for r in read(spark, sf, "pages").collect():
        body = re.sub(r"<[^<>]*$", "", re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1])
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert main_text(r.html) == "\n".join(b for b in blocks if b)


def test_segments():
    rnd = random.Random(6)
    for _ in range(200):
        s = [rnd.randint(-4, 4) for _ in range(rnd.randrange(14))]
        best = max((sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0)
        got = segments(s)
        assert (max((x for *_, x in got), default=0)) == max(best, 0) and all(sum(s[a:b]) == x > 0 for a, b, x in got)
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))


def test_segments_are_all_the_maximal_ones():
    """Best segment, then the best of what is left on either side, and so on; linear on a long downward drift."""

    def brute(s, at):
        best = max(((sum(s[i:j]), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0))
        return [*brute(s[: best[1]], at), (at + best[1], at + best[2]), *brute(s[best[2] :], at + best[2])] if best[0] > 0 else []

    rnd = random.Random(13)
    for _ in range(150):
        s = [rnd.gauss(-0.2, 1) for _ in range(rnd.randrange(18))]
        assert [(a, b) for a, b, _ in segments(s)] == brute(s, 0)
    s = [1.0, -1.1] * 200_000
    assert len(segments(s)) == 200_000


def test_toxic_evidence():
    """One segment counts as itself, several as their sum statistic, none below significance; passages come with their places."""
    m = ToxicityModel({b"bad": 3.0, b"worse": 4.0}, -0.5, lam=1.0, k=0.1)
    assert m.bits(100, []) == 0 and m.bits(100, [(0, 1, 2.0)]) == 0 and abs(m.bits(100, [(0, 1, 7.0)]) - (7 - np.log(10))) < 1e-9
    two = m.bits(100, [(0, 1, 7.0), (5, 6, 6.0)])
    t = 13 - 2 * np.log(10)
    assert abs(two - (t - np.log(t) + np.log(2) - np.log(2))) < 1e-9 and two > m.bits(100, [(0, 1, 7.0)])
    n, found = m.passages("a bad worse day " + "and so on " * 30 + "worse bad")
    assert n == 96 and [(a, b) for a, b, _ in m.significant(n, found)] == [(1, 3), (94, 96)]
    assert m.passages("") == (0, []) and m.significant(0, []) == []


def test_quality_votes(spark, none, docs):
    """Each score against votes counted one by one; null and empty texts, repeated rows."""
    sf = "/root/testdata/sf0.001"
    d, y = read(spark, sf, "documents"), read(spark, sf, "labels")
    m = fit_quality(d.unionByName(d), y, neighbours=7)
    assert len(m.labels) == y.where("quality is not null").count() - sum(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in y.collect())
    rows = [(r.doc_id, r.text) for r in d.limit(60).collect()] + [(10**6, None), (10**6 + 1, ""), (10**6, None)]
    for r in score_quality(spark.createDataFrame(rows, "doc_id long, text string"), m, keep=("doc_id", "text")).collect():
        z = m.project(features(r.text or "")[None])[0].astype(float)
        near = sorted(((float(v.astype(float) @ z), label) for v, label in zip(m.vectors, m.labels, strict=True)), reverse=True)[:7]
        votes = [(max(c, 0.0) ** 8, label) for c, label in near]
        want = (sum(w * v for w, v in votes) + 0.1 * m.prior) / (sum(w for w, _ in votes) + 0.1)
        assert abs(r.score - want) < 1e-3 and r.predicted == int(r.score >= 0.3)


@pytest.mark.parametrize(("label", "fit", "score", "least"), [("quality", fit_quality, score_quality, 0.9), ("toxic", fit_toxicity, score_toxicity, 0.9)])
def test_classifiers(spark, docs, none, label, fit, score, least):
    sf = "/root/testdata/sf0.01"
    d, y = read(spark, sf, "documents"), read(spark, sf, "labels")
    model = fit(d, y)
    out = {r.doc_id: r for r in score(d, model).collect()}
    held = [r for r in y.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(out) == 1000 and np.mean([out[r.doc_id].predicted == r[label] for r in held]) >= least
    assert all(0 <= r.score <= 1 for r in score(docs, model).collect()) and score(none, model).count() == 0
    assert fit(d, y.limit(0)) is not None


def test_id_records(spark, docs, none):
    tok = load_tokenizer(open(JSON, "rb").read())
    path = new_output(spark)
    write_id_records(docs, path, JSON)
    got = read_index(spark, path).orderBy("start").collect()
    order = sorted(((i if i != 3 else None, t or "") for i, t in enumerate(TEXTS)), key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (i, t) in zip(got, order, strict=True):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    some = read_index(spark, path).where("doc_id in (5, 6)")
    assert sorted(len(r.ids) for r in read_records(spark, path, some).collect()) == sorted(r.n_tokens for r in got if r.doc_id in (5, 6))
    write_id_records(none, empty := new_output(spark), JSON)
    assert read_index(spark, empty).count() == 0
    raw = bytearray(frame(7, np.array([1, 2, 3], np.uint16)) + b"\n")
    assert [(i, x.tolist()) for _, _, i, x in frames(memoryview(bytes(raw)))] == [(7, [1, 2, 3])]
    raw[25] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(frames(memoryview(bytes(raw))))


def test_encoder_gives_the_ids_of_the_library(spark, sf):
    """Real texts, made-up ones of all kinds of characters, added tokens, characters of new Unicode versions; a memory that forgets."""
    spec = open(JSON, "rb").read()
    tok, bounds = load_tokenizer(spec), doubtful()
    rnd = random.Random(9)
    odd = ["\U0001fad8", "\U0001e900", "\u1c80", "\u180e", "\u0085", "\x1c", "\u200b", "\u0378", "\u4e00", "\u0301", "\u00b2", "\u2167", "<|endoftext|>", "'s", "'S", " ", "  ", "\n", "\t", "\r\n", "ab", "Z", "7", "_", "-", "é", "ß"]
    texts = [r.text or "" for r in read(spark, sf, "documents").collect()] + ["".join(rnd.choice(odd) for _ in range(rnd.randrange(60))) for _ in range(3000)] + TEXTS[1:]
    want = [np.array(e.ids, "<u2").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    for forget in (400_000, 50):
        encode = IdEncoder(spec, bounds)
        encode.chunks.size = encode.firsts.size = forget
        got = []
        for at in range(0, len(texts), 100):
            ids, ends = encode(texts[at : at + 100])
            got += [ids[a:b].astype("<u2").tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        assert got == want
    assert [len(x) for x in encode([])] == [0, 0]
    safe = "".join(c for c in map(chr, range(0x11000)) if not "\ud800" <= c <= "\udfff" and not bisect_right(bounds, ord(c)) & 1)
    mixed = "".join(f"x{c}1x{c}{c}!\n" for c in safe)
    assert [mixed[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(mixed)] == regex.findall(PATTERN, mixed)
    other = open(P.path("word_bpe_49k.json"), "rb").read()
    assert IdEncoder(other, bounds)(["Some words, 12"])[0].tolist() == load_tokenizer(other).encode("Some words, 12", add_special_tokens=False).ids


def test_id_records_of_many_shards(spark):
    """Ranges of ids over several shards, an id that fills more than one, columns whose names the writer uses itself."""
    rows = [(i if i % 3 else 7, f"text {i} " * 50, i, "x") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, body string, start int, packed string")
    path = new_output(spark)
    write_id_records(df, path, JSON, id_col="id", text_col="body", shard_bytes=4000)
    index = read_index(spark, path)
    got = index.orderBy("start").collect()
    assert len({r.shard for r in got}) > 3 and [r.doc_id for r in got] == sorted(r[0] for r in rows)
    assert len({r.shard for r in got if r.doc_id == 7}) > 1
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    some = {(r.doc_id, tuple(r.ids)) for r in read_records(spark, path, index.where("doc_id % 2 = 0")).collect()}
    assert some == {(r.doc_id, tuple(r.ids)) for r in read_records(spark, path).collect() if r.doc_id % 2 == 0}


def test_pipeline_stages_take_odd_rows(spark, sf, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, an empty table, clashing column names."""
    import corpus_pipeline as c

    some = read(spark, sf, "documents").limit(30)
    odd = [(None, None, None, None, None), (-1, "", "en", None, 0), (-2, None, None, "s", None), (-3, LONG * 4, "en", "s", 1), (-4, "twice", "en", "s", 1), (-4, "twice", "en", "s", 1), (None, "twice again", None, None, None)]
    docs = some.unionByName(spark.createDataFrame(odd, some.schema)).withColumns({n: F.lit(1) for n in ("score", "leaks", "node", "key", "fp", "d")})
    for name, stage in c.STAGES:
        out, none = stage(spark, docs, sf), stage(spark, docs.limit(0), sf)
        assert none.count() == 0 and (name == "encode" or out.columns == none.columns == docs.columns), name
        kept = out.collect()
        assert name == "encode" or all(r.score == r.leaks == r.node == r.key == r.fp == r.d == 1 for r in kept), name
        if name == "near_dedup":
            assert sum(r.doc_id == -4 for r in kept) == 1 and sum(not (r.text or "") for r in kept) == 1
        elif name == "encode":
            assert len(kept) == docs.count() and sum(r.n_tokens == 0 for r in kept) >= 3
        else:
            assert sum(r.doc_id == -4 for r in kept) in (0, 2) and len(kept) >= 10
    for name in ("documents", "labels", "benchmark"):
        read(spark, sf, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0
    some.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert c.run(spark, str(tmp_path)).count() <= 30


def test_queries_and_pipeline(spark, sf):
    n = read(spark, sf, "documents").count()
    for name in ("op1_token_counts", "op3_simhash_dedup", "op4_bpe_codec", "op5_quality", "op6_winnowing", "op9_toxicity", "op10_id_records"):
        assert q.QUERIES[name](spark, sf).count() == n, name
    import corpus_pipeline as c

    docs = read(spark, sf, "documents")
    assert 4 <= len(c.STAGES) <= 5
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
    assert c.run(spark, sf).count() == docs.count()
