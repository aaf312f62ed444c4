"""The training-data operators against brute force and SQL, with odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from prismcat.llm import _tokens, chat, exact_dedup, hmm_lm, mixing, packing, registry, simhash, simhash_wide, substring_dedup, token_files, topk, toxicity
from tests.compare import check, duck
from tests.llm.conftest import frame, odd_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, con, name):
    assert check(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name], SF) > 0


# --- encoder -----------------------------------------------------------------------------------------------------

ODD_TEXTS = [
    "a\n b", " a", "a  b", "a \nb", "  ", "", "x ", "\n\n y", "don't we'll İSTANBUL ΣΑΣ", "a\n \nb", "<|endoftext|> x <|endoftext|>", "é é\x85 \xa0 k", "a\tb c", "\x1c a", "a 　b",
    "naïve café ＡＢ 12 345 !!! ..", "é ́x", "a.\nb. c,\nd \ne", "x\ny\n\nz k\n", "Łódź. Čeština, Ünïcödé\nÉté ªº µ ß ŉ ǅ", "日本 語. Ж а", "it's IT'S ***a,&&&b 1234 5x", None,
]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(file, monkeypatch):
    monkeypatch.setattr(_tokens, "CACHE_UNITS", 50)
    monkeypatch.setattr(_tokens, "CACHE_PIECES", 50)
    enc = _tokens.UnitEncoder(public_tokenizers.path(file))
    rnd = random.Random(3)
    alphabet = [" ", " ", " ", "\n", ".", ",", "'", "s", "a", "é", "B", "1", "_", "-", "\t", " ", "İ", "Σ", "日"]
    texts = ODD_TEXTS + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40))) for _ in range(800)]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        want = [struct.pack(f"<{len(x.ids)}I", *x.ids) for x in enc.tok.encode_batch([t or "" for t in part], add_special_tokens=False)]
        assert enc.encode(part) == want


# --- packing -----------------------------------------------------------------------------------------------------


def sequences_of(counts, capacity):
    out = defaultdict(list)
    for n, runs in packing.plan(counts, capacity).items():
        for (a, o, s), (b, _, _) in zip(runs, [*runs[1:], (counts[n], 0, 0)]):
            for i in range(a, b):
                out[s + i - a].append((o, n))
    return out


def test_plan_places_all_without_gaps():
    rnd = random.Random(1)
    for _ in range(200):
        capacity = rnd.choice([5, 30, 2048])
        counts = {rnd.randint(1, capacity): rnd.randint(1, 20) for _ in range(rnd.randint(1, 40))}
        found = sequences_of(counts, capacity)
        for parts in found.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= capacity
            assert sum(3 * n > capacity for _, n in parts) <= 2
        assert sum(map(len, found.values())) == sum(counts.values())
        # never more than a common best-fit-decreasing packing needs
        gaps = []
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fit = min((g for g in gaps if g >= n), default=None)
            if fit is None:
                gaps.append(capacity - n)
            else:
                gaps.remove(fit)
                gaps.append(fit - n)
        assert len(found) <= len(gaps) + 1


@pytest.mark.parametrize("clash", [False, True])
def test_packing(spark, odd, odd_clash, clash):
    capacity = 256
    packed = packing.pack(odd_clash if clash else odd, capacity, with_ids=True)
    tok = _tokens.UnitEncoder(public_tokenizers.path("byte_bpe_50k.json")).tok
    want = Counter()
    for doc, text, _ in odd_rows():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        cut = len(ids) % capacity or capacity
        starts = [0, *range(cut, len(ids), capacity)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[doc, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    rows = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert set(whole) == set(places)
    for r in rows:
        assert zlib.crc32(bytes(whole[r.sequence_id].ids)[4 * r.offset : 4 * (r.offset + r.length)]) == r.ids_crc32


# --- substrings --------------------------------------------------------------------------------------------------


def removed(rows):
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    at = 0
    while at < len(order):
        same = [i for i in order[at:] if rows[i][0] == rows[order[at]][0]]
        fresh = set()
        for i in same:
            b = (rows[i][1] or "").encode()
            gone = bytearray(len(b))
            for p in range(len(b) - 49):
                if b[p : p + 50] in seen:
                    gone[p : p + 50] = b"\1" * 50
                fresh.add(b[p : p + 50])
            kept = bytes(c for c, g in zip(b, gone) if not g)
            out.append((rows[i][0], len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
        seen |= fresh
        at += len(same)
    return Counter(out)


@pytest.mark.parametrize("clash", [False, True])
def test_substrings(spark, odd, odd_clash, clash):
    got = substring_dedup.remove(odd_clash if clash else odd).collect()
    assert Counter(tuple(r) for r in got) == removed(odd_rows())


def test_substrings_hot_passage_and_text(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", 4)
    monkeypatch.setattr(substring_dedup, "BLOCK", 2000)
    rnd = random.Random(2)
    noise = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    line, short = noise(60), noise(30)
    rows = [(k, noise(rnd.randint(0, 200)) + (line if k % 3 else short) + noise(rnd.randint(0, 200)), "s") for k in range(150)]
    df = substring_dedup.remove(frame(spark, rows), with_text=True)
    got = df.collect()
    assert Counter(tuple(r)[:5] for r in got) == removed(rows)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_substrings_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 300)
    monkeypatch.setattr(substring_dedup, "BLOCK", 1000)
    monkeypatch.setattr(substring_dedup, "SMALL", 8)
    rnd = random.Random(12)
    noise = lambda n: "".join(rnd.choice("abcdefg ") for _ in range(n))
    shared = [noise(n) for n in (49, 50, 51, 400, 1500)]
    rows = [(k, "".join(x for _ in range(rnd.randint(1, 9)) for x in (noise(rnd.randint(0, 400)), rnd.choice(shared))), None) for k in range(25)]
    assert Counter(tuple(r) for r in substring_dedup.remove(frame(spark, rows)).collect()) == removed(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("blocks_")]


def test_equal_windows_never_meet_a_boundary():
    rnd = random.Random(13)
    strings = [bytes(rnd.choice(b"ab") for _ in range(60)) for _ in range(400)]
    first = np.array([int.from_bytes(s[5:13], "big") for s in strings], dtype=np.uint64)
    ranges = substring_dedup.Ranges(np.unique(rnd.sample(first.tolist(), 20)).astype(np.uint64), np.zeros(0, dtype=np.uint64))
    own = ranges.of(strings, np.full(len(strings), 5))
    lead = defaultdict(set)
    for s, r in zip(strings, own.tolist()):
        lead[s[5:13]].add(r)
    assert all(len(v) == 1 for v in lead.values()) and len(set(own.tolist())) > 5


def test_multikey_cuts_segments_in_three(monkeypatch):
    monkeypatch.setattr(substring_dedup, "SMALL", 3)
    test_multikey()


def test_multikey():
    rnd = random.Random(4)
    strings = [bytes(rnd.choice(b"ab") for _ in range(20)) for _ in range(300)]
    data = np.frombuffer(b"".join(strings) + b"\0" * 16, dtype=np.uint8)
    order, group = substring_dedup.multikey(data, np.arange(300) * 20, 18)
    got = [strings[i][:18] for i in order]
    assert got == sorted(got)
    assert all((group[i] == group[i - 1]) == (got[i] == got[i - 1]) for i in range(1, 300))


# --- chat --------------------------------------------------------------------------------------------------------


def test_chat(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "Ann", "Hi"), (1, 2, "Bob", None), (1, 3, "Ann", "Bye"), (1, 3, "Ann", "Bye"), (1, 700, "Cy", "late"), (1, None, None, "who"),
        (2, 0, "system", "alone"), (None, 5, "Ann", "lost"), (3, 0, "Ann", ""),
    ]
    df = spark.createDataFrame([r + ("x", "y") for r in rows], "conv_id long, turn long, role string, text string, span string, perspective string")
    rendered = chat.render(df)
    texts = {(r.conv_id, r.perspective): r for r in chat.dialogues(rendered).collect()}
    assert set(texts) == {(1, "Ann"), (1, "Bob"), (1, "Cy"), (None, "Ann"), (3, "Ann")}
    bob = texts[1, "Bob"]
    u = lambda n, t: f"<|im_start|>user name={n}\n{t}<|im_end|>\n"
    assert bob.text == "<|im_start|>system\nBe kind.<|im_end|>\n" + u("Ann", "Hi") + "<|im_start|>assistant\n<|im_end|>\n" + u("Ann", "Bye") * 2 + u("Cy", "late") + u("unknown", "who")
    assert [bob.text[m.start : m.end] for m in bob.masks] == ["<|im_end|>\n"]
    assert [texts[1, "Ann"].text[m.start : m.end] for m in texts[1, "Ann"].masks] == ["Hi<|im_end|>\n", "Bye<|im_end|>\n", "Bye<|im_end|>\n"]
    for r in rendered.collect():
        assert texts[r.conv_id, r.perspective].text[r.char_start : r.char_end] == r.segment
    assert chat.render(df.limit(0)).count() == 0


# --- simhash -----------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=2):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                up[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("clash", [False, True])
def test_simhash(spark, odd, odd_clash, clash):
    rows = odd_rows()
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    root = brute_components(fps)
    least = {}
    for (d, _, _), r in zip(rows, root):
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    want = Counter((d, f - 2**64 if f >= 2**63 else f, least[r]) for (d, _, _), f, r in zip(rows, fps, root))
    source = odd_clash if clash else odd
    assert Counter((r.doc_id, r.fp, r.component_id) for r in simhash.components(source).collect()) == want


def jaccard_classes(texts, similarity=0.8, words=5):
    sets_ = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets_.append({b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)} or ({b" ".join(w)} if w else set()))
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets_):
        for j in range(i):
            b = sets_[j]
            if len(a & b) >= similarity * len(a | b):
                up[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def kept_of(rows, classes):
    """(doc_id, text) of each class's row with the smallest id."""
    best = {}
    for (d, t, _), c in zip(rows, classes):
        best.setdefault(c, []).append((d is None, d or 0, d, t or ""))
    return {c: [x for x in v if x[:2] == min(v)[:2]] for c, v in best.items()}


def near_copies(seed, groups, each):
    """Texts with some words changed, and texts that share half their words only."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijk") for _ in range(5))
    rows = []
    for g in range(groups):
        base = [word() for _ in range(rnd.choice([60, 150, 400]))]
        for _ in range(rnd.randint(1, each)):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(own) // 70))):
                own[rnd.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own), "s"))
        rows.append((len(rows), " ".join(base[: len(base) // 2] + [word() for _ in base[::2]]), "s"))
    return rows


@pytest.mark.parametrize("clash", [False, True])
def test_near_dedup_of_odd_rows(spark, odd, odd_clash, clash):
    source, rows = (odd_clash if clash else odd), odd_rows()
    kept = simhash_wide.near_dedup(source)
    assert kept.columns == source.columns
    got = Counter((r.doc_id, r.text or "") for r in kept.collect())
    want = kept_of(rows, jaccard_classes([t for _, t, _ in rows]))
    assert sum(got.values()) == len(want)
    assert all(any(got[d, t] == 1 for _, _, d, t in v) for v in want.values())


def test_near_dedup_of_repeated_and_null_ids(spark):
    base = [f"w{k}" for k in range(80)]
    texts = [" ".join(base), " ".join(base[:-1] + ["x"]), " ".join(base[::-1])]
    for ids in ([1, 1, 1], [None, None, None], [5, None, 5]):
        rows = [(d, t, None) for d, t in zip(ids, texts)] + [(ids[0], texts[0], None)]
        got = [(r.doc_id, r.text) for r in simhash_wide.near_dedup(frame(spark, rows)).collect()]
        assert len(got) == 2 and {t for _, t in got} > {texts[2]} and all(d == ids[0] for d, _ in got)


@pytest.mark.parametrize("block", [1_500_000, 8000])
def test_near_dedup_finds_what_brute_force_finds(spark, monkeypatch, block):
    monkeypatch.setattr(simhash_wide, "BLOCK", block)
    monkeypatch.setattr(simhash_wide, "FRONT", 7)
    rows = near_copies(11, 25, 40)
    got = {r.doc_id for r in simhash_wide.near_dedup(frame(spark, rows)).collect()}
    want = {v[0][2] for v in kept_of(rows, jaccard_classes([t for _, t, _ in rows])).values()}
    assert want <= got and len(got - want) <= 0.01 * len(rows)


@pytest.mark.parametrize("cell", [1, 200])
def test_near_dedup_with_hot_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash_wide, "CELL", cell * 8)
    monkeypatch.setattr(simhash_wide, "SAMPLE", 4)
    rows = near_copies(12, 10, 30)
    base = " ".join(f"h{k}" for k in range(200))
    rows += [(len(rows) + k, f"{base} x{k}", "s") for k in range(150)]
    got = {r.doc_id for r in simhash_wide.near_dedup(frame(spark, rows)).collect()}
    want = {v[0][2] for v in kept_of(rows, jaccard_classes([t for _, t, _ in rows])).values()}
    assert want <= got and len(got - want) <= 0.01 * len(rows)


def test_guests_meet_all_residents():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, (1, 2), dtype=np.uint64)
    fp = np.concatenate([np.repeat(base, 50, axis=0), base ^ np.uint64(3), rng.integers(0, 2**63, (3, 2), dtype=np.uint64)])
    label = np.array([0] * 50 + [1, 2, 3, 4])
    guest = np.array([0] * 50 + [1] * 4)
    assert simhash_wide.meet_guests(fp, label, guest, 8) == [(50, 0)]


def test_wide_limits():
    assert abs(simhash_wide.bit_rate(0.8) - 0.1514) < 1e-3
    for nodes in (2, 1000, 10**6, 10**10):
        coords, many = simhash_wide.grids(nodes, 0.8)
        assert 1 - (1 - (1 - simhash_wide.bit_rate(0.8)) ** coords) ** many >= simhash_wide.FOUND
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    sets_ = [base, np.concatenate([base[:2667], rng.integers(0, 2**63, 333, dtype=np.uint64)])]  # similarity 0.8
    fp = simhash_wide.wide(np.concatenate(sets_), np.array([3000, 3000]))
    assert np.bitwise_count(fp[0] ^ fp[1]).sum() <= simhash_wide.limit(512, 0.8)


def test_points_two_steps_apart_share_a_cell(spark):
    for nodes in (2, 1000, 10**6, 10**10):
        coords, many = simhash_wide.grids(nodes, 0.8, 2)
        p = simhash_wide.bit_rate(0.8)
        assert (1 - sum(math.comb(coords, k) * p**k * (1 - p) ** (coords - k) for k in range(3))) ** many <= 1 - simhash_wide.FOUND
    # of the grids for two nodes, the first has points two steps apart, the others differ too
    picks = [np.random.default_rng(k).choice(simhash_wide.WIDE, 4, replace=False).tolist() for k in range(8)]
    base = np.random.default_rng(1).integers(0, 2, simhash_wide.WIDE, dtype=np.uint8)
    for steps, linked in ((2, True), (3, False)):
        other = base.copy()
        other[picks[0][:steps]] ^= 1
        for pick in picks[1:]:
            if (other[pick] == base[pick]).all():
                other[next(c for c in pick if c not in picks[0])] ^= 1
        rows = [(k, bytearray(np.packbits(x, bitorder="little").tobytes())) for k, x in enumerate((base, other))]
        found = simhash_wide.candidates(spark.createDataFrame(rows, "node long, wide binary"), 0.8, simhash_wide.Scratch(spark, "test_cells")).collect()
        assert {tuple(sorted(r)) for r in found if r.a != r.b} == ({(0, 1)} if linked else set())


def test_near_forest_joins_all_near_rows():
    rnd = random.Random(3)
    rows = []
    for _ in range(12):
        x = [rnd.getrandbits(64), rnd.getrandbits(64)]
        for _ in range(rnd.randint(1, 60)):
            rows.append([v ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for v in x])
    fp = np.array(rows, dtype=np.uint64)
    want = brute_components([a | b << 64 for a, b in rows], 8)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in simhash_wide.near_forest(fp, 8):
        assert root(a) != root(b)
        up[root(a)] = root(b)
    assert all((root(i) == root(j)) == (want[i] == want[j]) for i in range(len(rows)) for j in range(i))


def test_points_bound_the_distance():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 2**63, 500, dtype=np.uint64), rng.integers(0, 2**63, 500, dtype=np.uint64)
    assert (np.abs(simhash.embed(a) - simhash.embed(b)).sum(axis=1) <= np.bitwise_count(a ^ b)).all()


def test_runs_are_not_torn():
    keys = np.sort(np.random.default_rng(5).integers(0, 9, 200))
    parts = [(keys[a:b], np.arange(a, b)) for a, b in zip([0, 1, 1, 90, 150], [1, 1, 90, 150, 200])]
    got = list(simhash.runs(iter(parts)))
    assert np.concatenate([g[0] for g in got]).tolist() == keys.tolist()
    assert all(a[0][-1] != b[0][0] for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("at_once", [256, 2])
def test_simhash_links(spark, monkeypatch, at_once):
    monkeypatch.setattr(simhash, "AT_ONCE", at_once)
    rnd = random.Random(9)
    fps = {0, 2**64 - 1}
    for _ in range(30):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):
            fps.add(x)
            for _ in range(rnd.randint(1, 3)):
                x ^= 1 << rnd.randrange(64)
    fps = sorted(fps)
    found = simhash.edges(spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")).collect()
    at = {f: i for i, f in enumerate(fps)}
    edges = [(at[r.a % 2**64], at[r.b % 2**64]) for r in found]
    assert all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in edges)
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[root(a)] = root(b)
    want = brute_components(fps)
    assert all((root(i) == root(j)) == (want[i] == want[j]) for i in range(len(fps)) for j in range(i))


# --- exact dedup -------------------------------------------------------------------------------------------------


def test_cut_is_content_defined():
    rnd = random.Random(6)
    body = bytes(rnd.randrange(256) for _ in range(60_000))
    a, b = exact_dedup.cut([body, b"0123456789" * 70 + body])
    shift = len(b"0123456789" * 70)
    assert len(set(a) & {x - shift for x in b}) >= len(a) - 2
    for text, cuts in ((body, a), (b"", exact_dedup.cut([b""])[0])):
        assert all(n <= exact_dedup.MOST for n in np.diff([0, *cuts])) and (cuts[-1:] == [len(text)] or not text)


@pytest.mark.parametrize("clash", [False, True])
@pytest.mark.parametrize("clashing_ids", [False, True])
def test_exact(spark, odd, odd_clash, clash, clashing_ids, monkeypatch):
    source, rows = (odd_clash if clash else odd), odd_rows()
    if clashing_ids:  # all chunks share one identifier: the digests must tell them apart
        plain = exact_dedup.recipes
        monkeypatch.setattr(exact_dedup, "recipes", lambda d: plain(d).withColumn("ids", F.transform("ids", lambda x: F.lit(1).cast("long"))))
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[norm(t)].append((-len(t or ""), d is None, d or 0, d))
    want = Counter((d, min(groups[norm(t)])[3], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for d, t, _ in rows)
    got = exact_dedup.decide(source).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.exact_dedup(source)
    assert kept.columns == source.columns
    assert Counter(norm(r.text) for r in kept.collect()) == Counter(list(groups))


# --- top-k -------------------------------------------------------------------------------------------------------


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "TABLE_BLOCK", 40)
    monkeypatch.setattr(topk, "STEP", 8)
    rnd = random.Random(8)
    rows = [(k, [rnd.choice([-1.0, -0.5, 0.25, 0.5, rnd.random()]) for _ in range(6)]) for k in range(400)]
    rows += [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6), (1200, []), (1250, [0.5] * 3), (None, [9.0] * 6), (7, [2.0] * 6), (50, [0.0] * 6)]
    df = spark.createDataFrame([r + ("x", "y") for r in rows], "vec_id long, embedding array<float>, rank string, score string")
    usable = [(v, [math.floor(256 * x) for x in np.array(e, dtype=np.float32).astype(float)]) for v, e in rows if v is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for q in sorted({v for v, _ in usable if v % 50 == 0}):
        pad = lambda x: tuple(x) + (0,) * (6 - len(x))
        own = min((np.array(e, dtype="<f8").tobytes() for v, e in usable if v == q))
        x = pad(np.frombuffer(own).astype(int).tolist())
        scored = sorted((-sum(a * b for a, b in zip(x, pad(e))), v) for v, e in usable if v != q)[:5]
        want += [(q, n, v, -s) for n, (s, v) in enumerate(scored, 1)]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == want
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    rnd = random.Random(4)
    rows = [(k, [rnd.choice([-1, 1]) * rnd.random() * 1e38 for _ in range(3)]) for k in range(120)] + [(200, [1.0, 2.0, 3.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    whole = {v: [math.floor(256 * float(np.float32(x))) for x in e] for v, e in rows}
    want = []
    for q in (0, 50, 100, 200):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], e)), v) for v, e in whole.items() if v != q)[:5]
        want += [(q, n, v, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, v) in enumerate(scored, 1)]
    assert sorted(tuple(r) for r in got) == want


def test_top_k_stops_by_its_bounds():
    rng = np.random.default_rng(1)
    centres = rng.integers(-400, 400, (40, 8))
    x = np.floor(centres[rng.integers(0, 40, 3000)] + rng.normal(0, 8, (3000, 8)))
    q = x[:50]
    pivots = x[topk.farthest(x, 32)]
    far, qfar = topk._distances(x, pivots), topk._distances(q, pivots)
    seen, floor = [], np.full(50, np.iinfo(np.int64).min)
    held = topk.search_block(np.arange(50), q, qfar, floor, np.arange(3000), x, far, tuple(np.zeros(0, dtype=np.int64) for _ in range(3)), 5, seen)
    for k in range(50):
        scores = (x @ q[k]).astype(np.int64)
        want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != k)[:5]
        assert sorted((-s, i) for p, s, i in zip(*held) if p == k) == want
    assert sum(seen) < 0.5 * 50 * 3000


# --- language model ----------------------------------------------------------------------------------------------


def test_hmm_recursions():
    rng = np.random.default_rng(1)
    k, c = 3, 5
    model = hmm_lm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k).T.copy())
    sizes = np.array([1, 4, 2, 5, 3])
    seen = rng.integers(0, c, sizes.sum())
    got = model.forward(seen, sizes)
    starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((c, k))
    at = 0
    for size, score in zip(sizes, got):
        o = seen[at : at + size]
        at += size
        total = 0.0
        paths = [[s] for s in range(k)]
        for _ in range(size - 1):
            paths = [p + [s] for p in paths for s in range(k)]
        weights = []
        for p in paths:
            w = model.start[p[0]] * model.emit[o[0], p[0]]
            for t in range(1, size):
                w *= model.move[p[t - 1], p[t]] * model.emit[o[t], p[t]]
            weights.append(w)
            total += w
        assert abs(math.log10(total) - score) < 1e-9
        for p, w in zip(paths, weights):
            starts[p[0]] += w / total
            for t in range(size):
                emits[o[t], p[t]] += w / total
                if t:
                    moves[p[t - 1], p[t]] += w / total
    *counts, likelihood = model.expected(seen, sizes)
    for x, y in zip(counts, (starts, moves, emits)):
        assert np.allclose(x, y, atol=1e-5)
    assert abs(likelihood - got.sum()) < 1e-5


@pytest.mark.parametrize("clash", [False, True])
def test_language_model(spark, odd, odd_clash, clash):
    rows = odd_rows()
    tokens = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b""] for _, t, _ in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _, _ in rows]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((d, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for (d, _, _), ws, h in zip(rows, tokens, held))
    got = hmm_lm.score(odd_clash if clash else odd).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_language_model_of_long_texts_only(spark, monkeypatch):
    monkeypatch.setattr(hmm_lm, "START_TOKENS", 2000)
    monkeypatch.setattr(hmm_lm, "BLOCK", 4000)
    rnd = random.Random(7)
    topics = [[f"{t}w{k}" for k in range(40)] for t in "abcd"]
    rows = [(k, " ".join(rnd.choice(topics[(k + n // 500) % 4]) for n in range(6000)), None) for k in range(30)]
    models, plain = [], hmm_lm.trained
    monkeypatch.setattr(hmm_lm, "trained", lambda *a: models.append(plain(*a)) or models[-1])
    got = hmm_lm.score(frame(spark, rows)).collect()
    emit = models[0].emit
    assert all(np.abs(emit[:, a] - emit[:, b]).max() > 1e-3 for a in range(hmm_lm.STATES) for b in range(a))
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_language_model_deals_its_blocks_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(hmm_lm, "BLOCK", 60)
    dealt, plain = [], hmm_lm.coded

    def coded(*a):
        out = plain(*a)
        dealt.extend(r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect())
        return out

    monkeypatch.setattr(hmm_lm, "coded", coded)
    rows = [(k, " ".join(f"w{(k * n) % 97}" for n in range(59)), None) for k in range(64)]
    assert hmm_lm.score(frame(spark, rows)).count() == 64
    assert sum(dealt) == 64 and max(dealt) <= 8


def test_first_states_differ_without_a_sample():
    share = np.full(50, 0.02)
    for texts in ([], [np.zeros(3, dtype=np.uint16)]):
        emit = hmm_lm.first_model(texts, share).emit
        assert all(np.abs(emit[:, a] - emit[:, b]).max() > 1e-4 for a in range(hmm_lm.STATES) for b in range(a))


def test_language_model_beats_its_base(spark):
    got = [r for r in registry.QUERIES["op7_hmm_language_model"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


# --- mixing ------------------------------------------------------------------------------------------------------


def water(sizes):
    """Targets by plain iteration."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, stopped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        level = (left - sum(stopped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] >= 2 * sizes[s]]
        if not over:
            return stopped | {s: level * weight[s] for s in free}
        stopped |= {s: 2 * sizes[s] for s in over}


@pytest.mark.parametrize("shape", ["odd", "steep", "many", "thousands"])
def test_mixing(spark, odd_clash, shape):
    rnd = random.Random(3)
    if shape == "odd":
        rows, df = odd_rows(), odd_clash
    else:
        sizes = {"steep": [1, 1, 2, 400], "many": [rnd.randint(1, 50) for _ in range(17)], "thousands": [rnd.randint(1, 2) for _ in range(3000)]}[shape]
        rows = [(1000 * s + k, "w " * rnd.randint(1, 30), f"s{s:04}") for s, n in enumerate(sizes) for k in range(n)]
        df = frame(spark, rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    want = water(total)
    got = mixing.mix(df).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, size(t)) for d, t, _ in rows)
    by_doc = {d: s for d, _, s in rows}
    taken, largest = Counter(), Counter()
    for r in got:
        s = by_doc[r.doc_id] if r.doc_id is not None else None
        if r.doc_id is not None:
            assert r.source_size == total[s] and abs(r.target - want[s]) < 1e-6
            largest[s] = max(largest[s], r.size)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s in total:
        if s is not None and shape != "odd":
            assert abs(taken[s] - want[s]) <= largest[s]
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert sum(size(r.text) for r in out.collect()) == sum(r.taken for r in got)


# --- token files -------------------------------------------------------------------------------------------------


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for t in range(200):
        n, hi = int(rng.integers(0, 700)), int(rng.choice([1, 2, 300, 50_000, 2**32 - 1]))
        ids = rng.integers(0, hi, n, endpoint=True).astype(np.uint32)
        if n and t % 3 == 0:
            ids[rng.integers(0, n, max(1, n // 15))] = 2**32 - 1
        start, data = token_files.encode_blocks(ids)
        assert (token_files.decode_blocks(start, data) == ids).all()
        if len(start) > 2:
            assert (token_files.decode_blocks(start[1:2], data) == ids[128:256]).all()


@pytest.mark.parametrize("clash", [False, True])
def test_token_files(spark, odd, odd_clash, clash, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 500)
    tok = _tokens.UnitEncoder(public_tokenizers.path("word_bpe_49k.json")).tok
    want = Counter()
    for d, t, _ in odd_rows():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want[d, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
    token_files.write_tokens(odd_clash if clash else odd, f"file://{tmp_path}/out")
    got = token_files.read_tokens(spark, f"file://{tmp_path}/out").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert all(len(r.ids) == 4 * r.n_tokens and zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


# --- toxicity ----------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(900):
        bad = k % 4 == 0
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        if bad:
            text[rnd.randrange(len(text))] = rnd.choice(["vile", "Awful!"])
        rows.append((k, " ".join(text), None))
        labels.append((k, None, int(bad)))
    rows += [(2000, None, None), (2001, "", None), (None, "vile", None)]
    labels += [(3000, 1, 1), (None, 1, 1), (5, 1, None), (6, 1, 1), (6, 1, 0)]
    docs, marks = frame(spark, rows, clash=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, marks).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    held = [(r.predicted, int(d % 4 == 0)) for d, r in got.items() if r.held_out and d < 900]
    assert sum(p == y for p, y in held) / len(held) > 0.9
    assert got[2000].score == got[2001].score and got[None].predicted == 1
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(d for d, r in got.items() if d is not None and not r.predicted)


def test_fit_is_ftrl_proximal():
    rnd = random.Random(2)
    rows = [np.array(sorted(rnd.sample(range(40), rnd.randint(0, 8))), dtype=np.int32) for _ in range(120)]
    labels = np.array([float(3 in r or 7 in r) for r in rows])
    z, n, weight = defaultdict(float), defaultdict(float), {}

    def w(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for row, y in zip(rows, labels):
            at = [*row.tolist(), 1 << toxicity.BITS]
            weight = {i: w(i) for i in at}
            g = 1 / (1 + math.exp(-sum(weight.values()))) - y
            if abs(g) < 1e-3:
                continue
            for i in at:
                step = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - step * weight[i]
                n[i] += g * g
    got = toxicity.fit(rows, labels)
    want = np.zeros(len(got))
    for i in z:
        want[i] = w(i)
    assert np.allclose(got, want, atol=1e-9) and (want != 0).sum() > 2


def test_features_are_words_pairs_and_skip_pairs():
    words = [b"a", b"b", b"c", b"d"]
    h = [xxhash.xxh3_64_intdigest(x) for x in words]
    odd, mask = 0x9E3779B97F4A7C15, 2**64 - 1
    x = h + [(a * odd + b) & mask for a, b in zip(h, h[1:])] + [((a * odd + b) & mask) ^ 0x5BD1E995 for a, b in zip(h, h[2:])]
    assert toxicity.features(b"A, b C. d").tolist() == sorted({((v * odd) & mask) >> (64 - toxicity.BITS) for v in x})


def test_toxicity_does_not_depend_on_arrival(spark):
    rnd = random.Random(5)
    rows = [(k % 40, " ".join(rnd.choice(["vile", "calm", "x", "y", "z"]) for _ in range(6)), None) for k in range(200)]
    marks = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    a, b = (toxicity.train(frame(spark, r).repartition(n), marks) for r, n in ((rows, 1), (rows[::-1], 3)))
    assert np.array_equal(a, b)


def test_toxicity_learns_from_whole_texts(spark):
    rnd = random.Random(3)
    words = lambda: " ".join(f"w{rnd.getrandbits(40)}" for _ in range(9000))
    bad, good = words(), words()
    rows = [(k, f"{bad if k % 2 else good} n{k}", None) for k in range(60)]
    marks = spark.createDataFrame([(k, k % 2) for k, _, _ in rows], "doc_id long, toxic int")
    got = toxicity.train(frame(spark, rows), marks)
    order = sorted(rows, key=lambda r: (r[0] * 0x9E3779B97F4A7C15 % 2**64, r[0]))
    lists = [toxicity.features(t.encode()) for _, t, _ in order]
    assert all(len(x) > 25_000 for x in lists)
    assert np.array_equal(got, toxicity.fit(lists, np.array([float(d % 2) for d, _, _ in order])).astype(np.float32))
    assert (got[toxicity.features(bad.encode())[-1000:]] != 0).mean() > 0.9


# --- empty tables, pipeline --------------------------------------------------------------------------------------


def test_empty_tables(spark, none, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    token_files.write_tokens(none, f"file://{tmp_path}/out")
    for df in (
        packing.pack(none), substring_dedup.remove(none), simhash.components(none), simhash_wide.near_dedup(none), exact_dedup.decide(none), exact_dedup.exact_dedup(none), hmm_lm.score(none), mixing.mix(none),
        mixing.mixed(none), token_files.read_tokens(spark, f"file://{tmp_path}/out"), toxicity.score_documents(none, labels), toxicity.drop_toxic(none, labels),
    ):
        assert df.count() == 0


def test_pipeline(spark, monkeypatch):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    gone = {r.doc_id for r in toxicity.score_documents(docs, labels).where("predicted = 1").collect()}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(clean) == ids(docs) - gone
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    single = stages["exact_dedup"](spark, clean, SF).cache()
    best = {}
    for r in clean.collect():
        key = norm(r.text)
        best[key] = min(best.get(key, (math.inf, 0)), (-len(r.text or ""), r.doc_id))
    assert ids(single) == {d for _, d in best.values()}
    far = stages["simhash_near_dedup"](spark, single, SF).cache()
    rows = single.select("doc_id", "text").collect()
    least = {}
    for r, c in zip(rows, jaccard_classes([r.text for r in rows])):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert ids(far) == set(least.values())
    mix = stages["mixing"](spark, far, SF).cache()
    assert mix.columns == docs.columns
    copies = Counter(r.doc_id for r in mix.collect())
    assert copies == {r.doc_id: r.taken // r.size for r in mixing.mix(far).collect() if r.taken}
    packed = stages["packing"](spark, mix, SF).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]


@pytest.mark.parametrize("clash", [False, True])
def test_pipeline_on_odd_rows(spark, odd, odd_clash, clash):
    import corpus_pipeline

    docs = odd_clash if clash else odd
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
    rows = odd_rows()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in docs.collect())
    assert {r.doc_id for r in packed} <= {d for d, _, _ in rows}
