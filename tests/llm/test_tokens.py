import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from alertmill.llm import bpe, packing, tokens

PATH = bpe.default_vocabulary()
PIECES = ["a", "the ", "  ", "\n\n", "'re", "'s", "é", "日本", "😀", "123", "!!", "<|endoftext|>", " x", "zq", "　", "\t", "\x1c", "\x85"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=120).map("".join), st.integers(3, 60), st.integers(1, 20))
def test_any_cut_gives_the_library_ids(text, chunk, overlap):
    coder, want = bpe.load(PATH), bpe.library(PATH).encode(text, add_special_tokens=False).ids
    assert coder.encode(text).tolist() == want
    assert coder.encode_fragments(text, chunk).tolist() == want
    assert coder.count(text, chunk, overlap)[0] == len(want)
    assert coder.decode(np.array(want, np.uint32)) == text


ODD = st.one_of(st.sampled_from([*PIECES, "'", "'ll", "q'Z", "ⅷ", "²", "ǅ", "ʰ", "़", "\u200d", "<|", "|>", "text|"]), st.characters(exclude_categories=["Cs"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(ODD, max_size=60).map("".join))
def test_every_forced_boundary(text):
    coder, want = bpe.load(PATH), bpe.library(PATH).encode(text, add_special_tokens=False).ids
    assert coder.encode_fragments(text, 0).tolist() == want and coder.encode_fragments(text, 7).tolist() == want
    assert coder.count(text, 12, 4)[0] == len(want)
    for size in (0, 7):
        parts = coder.fragments(text, size)
        assert "".join(parts) == text and all(parts) and all(len(x) >= size for x in parts[:-1])


def test_cuts_are_many():
    """By the method: a boundary before each word, whatever the length of the text."""
    text = "the cat, a 12x; 日本"
    assert len(bpe.load(PATH).fragments(text * 100)) > 4
    assert bpe.load(PATH).fragments(text, 0) == ["the", " cat", ",", " a", " 12", "x", ";", " 日", "本"]


def test_text_without_white_space_has_stable_places():
    rng = random.Random(3)
    text = "".join(rng.choice("日本語東京都市") for _ in range(3000))
    n, chunks, widened = bpe.load(PATH).count(text, 200, 16)
    assert n == len(bpe.library(PATH).encode(text, add_special_tokens=False).ids) and widened == 0 and chunks < 25


@pytest.mark.parametrize("text", ["a" * 3000, " " * 2000, "ab" * 700 + " " + "c" * 900])
def test_texts_without_a_stable_place(text):
    n, chunks, widened = bpe.load(PATH).count(text, 100, 8)
    assert n == len(bpe.library(PATH).encode(text, add_special_tokens=False).ids) and widened > 0


def test_every_code_point():
    coder, lib = bpe.load(PATH), bpe.library(PATH)
    points = [c for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b{chr(c)}{chr(c)}1 'x {chr(c)}" for c in points]
    for t, want in zip(texts, lib.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert coder.encode(t).tolist() == want.ids


def rows(spark):
    rng = random.Random(5)
    data = [(i, "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 3, 40, 4000]))), rng.choice("abc"), i) for i in range(60)]
    data += [(100, None, "a", 0), (None, "x y", None, 0), (5, "same id", "b", 1), (7, "twice", "c", 2), (7, "twice", "c", 2)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, n_tokens long"), data


def test_tables(spark):
    df, data = rows(spark)
    lib = bpe.library(PATH)
    want = sorted((str(d), len(lib.encode(t or "", add_special_tokens=False).ids), len((t or "").encode())) for d, t, *_ in data)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_bytes"]) for r in tokens.token_counts(df, chunk_chars=64, overlap_chars=8).collect()) == want
    ids = lambda t: lib.encode(t or "", add_special_tokens=False).ids
    hashed = sorted((str(d), hashlib.sha256(np.array(ids(t), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in data)
    assert sorted((str(r["doc_id"]), r["ids_sha256"], r["decoded_sha256"]) for r in tokens.encoding_digests(df).collect()) == hashed
    back = tokens.decoded(tokens.encoded(df))
    assert sorted((str(r["doc_id"]), r["text"]) for r in back.collect()) == sorted((str(d), t or "") for d, t, *_ in data)
    assert tokens.token_counts(df.limit(0)).count() == 0


def test_packing(spark):
    df, data = rows(spark)
    lib = bpe.library(PATH)
    got = packing.packed(df, length=64).toPandas()
    sequences = got.groupby("sequence_id")["length"].sum().sort_index()
    assert (sequences.iloc[:-1] == 64).all() and list(sequences.index) == list(range(len(sequences)))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]]
    whole = sorted(sum((list(x) for x in g.sort_values("start")["ids"]), []) for _, g in got[got.doc_id.notna() & ~got.doc_id.isin([5, 7])].groupby("doc_id"))
    assert whole == sorted(lib.encode(t or "", add_special_tokens=False).ids + [1] for d, t, *_ in data if d is not None and d not in (5, 7))
    assert got["length"].sum() == sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in data)
    share = got.groupby(["sequence_id", "source"])["length"].sum().unstack().fillna(0).iloc[:-1]
    assert (share.max() - share.min() <= 2).all()
    assert packing.packed(df.limit(0)).count() == 0


def dealt_in_rounds(totals, weights, length):
    """The rounds one by one, with the deficits kept: (window, queue, tokens)."""
    rest, deficit, out, window = list(totals), [Fraction(0)] * len(totals), [], 0
    while any(rest):
        need, size = min(length, sum(rest)), sum(weights)
        give = []
        for i, w in enumerate(weights):
            deficit[i] += Fraction(w * need, size)
            give.append(math.floor(sum(deficit[: i + 1])))
            deficit[i] -= give[i]
        out.append(give)
        rest = [r - g for r, g in zip(rest, give, strict=True)]
        window += 1
    return np.array(out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=25))
def test_deficits_carry_on(totals):
    length = 64
    totals = [t for t in totals if 2 * t * length >= sum(totals)] or totals[:1]
    windows = np.arange(-(-sum(totals) // length) + 1)
    plan = packing.phases(totals, totals, length)
    q = np.stack([packing.sent(windows, i, plan, length)[1] for i in range(len(totals))], axis=1)
    assert len(plan) == 1 and q[-1].tolist() == totals and (np.diff(q, axis=0) == dealt_in_rounds(totals, totals, length)).all()
    exact = np.minimum(windows * length, sum(totals))[:, None] * np.array(totals) / sum(totals)
    assert (abs(q - exact) < 1).all()
    large = packing.phases([t * 10**9 for t in totals], totals, length * 10**9)  # numbers beyond 64 bits
    assert (abs(np.stack([packing.sent(windows, i, large, length * 10**9)[1] for i in range(len(totals))], axis=1) / 10**9 - q) <= 1).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5000), st.integers(24, 60)), min_size=1, max_size=12))
def test_queues_that_end_leave_their_proportion_to_the_others(queues):
    length, totals, weights = 64, [t for t, _ in queues], [w for _, w in queues]
    plan = packing.phases(totals, weights, length)
    n = -(-sum(totals) // length)
    windows = np.arange(n + 1)
    ahead, own = (np.stack(x, axis=1) for x in zip(*[packing.sent(windows, i, plan, length) for i in range(len(totals))], strict=True)) if n else (np.zeros((1, len(totals))),) * 2
    assert own[-1].tolist() == totals and (own.sum(axis=1) == np.minimum(windows * length, sum(totals))).all() and (np.diff(own, axis=0) >= 0).all()
    assert (ahead == np.cumsum(own, axis=1) - own).all()
    for q, total in enumerate(totals):
        for token in {0, total // 3, total - 1} - {-1} if total else ():
            assert packing.window_at(token, q, plan, length) == np.searchsorted(own[:, q], token, side="right") - 1
    for phase in plan:  # proportions hold while no queue ends
        w = np.diff(phase.weights)
        nxt = min([p.first for p in plan if p.first > phase.first], default=n)
        if (own[nxt] < totals).all():
            gone = np.diff(own[[phase.first, nxt]], axis=0)[0]
            assert (abs(gone - gone.sum() * w / w.sum()) < 1).all()


def test_packing_towards_targets(spark):
    df, data = rows(spark)
    got = packing.packed(df.drop("n_tokens"), length=64, targets={"a": 0.5, "c": 0.25}).toPandas()
    ids = bpe.library(PATH)
    assert got["length"].sum() == sum(len(ids.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in data)
    share = got.groupby(["sequence_id", "source"])["length"].sum().unstack().fillna(0)
    assert (share.sum(axis=1).iloc[:-1] == 64).all()
    whole = share.iloc[: int(min(share[s][::-1].ne(0).idxmax() for s in ("a", "b", "c")))]  # until one ends
    assert len(whole) > 10 and (whole["a"] - 32).abs().max() <= 1 and (whole["c"] - 16).abs().max() <= 1
    with pytest.raises(ValueError):
        packing.packed(df, targets={"a": 0.9, "b": 0.2})


def test_registered_packing_against_brute_force(spark):
    """Every registered column of every piece, from pieces laid by rounds one after the other."""
    df, data = rows(spark)
    ids = {(str(d), t): np.array(bpe.library(PATH).encode(t or "", add_special_tokens=False).ids + [1], "<u4") for d, t, *_ in data}
    got = packing.packed_digests(df, length=64).toPandas()
    pieces = {}
    for r in got.to_dict("records"):
        pieces.setdefault(r["sequence_id"], []).append(r)
    text = {str(d): t for d, t, *_ in data if d not in (5, 7)}
    seen = {}
    for number, own in sorted(pieces.items()):
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
            name = str(None if r["doc_id"] != r["doc_id"] else int(r["doc_id"]))
            if name in text:
                whole = ids[name, text[name]]
                assert r["doc_tokens"] == len(whole) and r["ids_crc32"] == zlib.crc32(whole[r["start"] : r["start"] + r["length"]].tobytes())
                seen.setdefault(name, []).append((r["start"], r["length"]))
        assert at == 64 or number == max(pieces)
    for name, spans in seen.items():
        assert [a for a, _ in sorted(spans)] == [0, *np.cumsum([n for _, n in sorted(spans)])[:-1]] and sum(n for _, n in spans) == len(ids[name, text[name]])
    assert set(seen) == set(text)
    totals = got.groupby("source")["length"].sum()
    own = [s for s in sorted(totals.index) if totals[s] * 64 >= 2 * totals.sum()]
    want = dealt_in_rounds(*[[totals.sum() - totals[own].sum(), *totals[own]]] * 2, 64)
    have = got.groupby(["sequence_id", "source"])["length"].sum().unstack().fillna(0)
    assert (have[own].to_numpy() == want[:, 1:]).all() and (have.drop(columns=own).sum(axis=1).to_numpy() == want[:, 0]).all()
