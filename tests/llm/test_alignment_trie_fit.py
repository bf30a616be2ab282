"""Alignment of tokenizers, the prefix trie and best-fit packing against brute force, and their defined cases."""

import hashlib
import math
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfsense.llm import alignment, best_fit, prefix_trie  # noqa: E402

KIND = "doc_id long, text string, lang string, block string, pair long, part string"
POOL = ["alpha", "beta's", "Gamma", "été", "日本", "x1y2", "eps.", "don't", "snowman☃", "naïve,"]
ODD = [None, "", " ", "\n", "  two  blanks ", "a\x00b a\x00c", "▁native mark", "<|endoftext|> </s> <0x41>", "tab\tand\x0bvt\x85", "😀" * 50, "word " * 4000]


def text(rng, n):
    return rng.choice([" ", "  ", "\n"]).join(rng.choice(POOL) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = list(enumerate(ODD + [text(rng, rng.randrange(1, 60)) for _ in range(40)])) + [(None, "null id"), (12, "repeated id"), (12, "repeated id")]
    return spark.createDataFrame([(k, t, "en", "clash", 1, "clash") for k, t in rows], KIND)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def paths():
    import public_tokenizers as files

    return files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model"), files.path("word_bpe_49k.json")


def test_gallop_is_the_lower_bound():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (1, 1), (3, 400), (400, 3), (1000, 1000), (64, 65)):
        short, long = (np.unique(rng.integers(0, 3000, k)) for k in (n, m))
        assert alignment.gallop(short, long).tolist() == np.searchsorted(long, short).tolist()


def brute_alignment(rows):
    """Straight from the definition, with both libraries on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    path_a, path_b, _ = paths()
    a_lib = Tokenizer.from_file(path_a)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=path_b)
    shown = {ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0]: bytes([c]) for c in range(128)}
    made, counts = [], Counter()
    for t in rows:
        full = " " + (t or "")
        a, b = a_lib.encode(full, add_special_tokens=False), b_lib.encode(t or "")
        chars_to_bytes = [len(full[:k].encode()) for k in range(len(full) + 1)]
        spell_b = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_lib.id_to_piece(i)) for i in b)]
        if not t or b"".join(spell_b) != full.encode():
            made.append(None)
            continue
        # Bytes of A's tokens from the shown letters, each of which is one byte.
        sizes_a = [len(a_lib.id_to_token(i)) for i in a.ids]
        assert sum(sizes_a) == chars_to_bytes[-1] and shown["Ġ"] == b" "
        ea, eb = np.cumsum(sizes_a).tolist(), np.cumsum([len(x) for x in spell_b]).tolist()
        links = [
            (a.ids[i], b[j]) for i in range(len(ea)) for j in range(len(eb)) if max(ea[i] - sizes_a[i], eb[j] - len(spell_b[j])) < min(ea[i], eb[j])
        ]
        counts.update(links)
        shown_groups, at_a, at_b = [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            to_a, to_b = ea.index(end) + 1, eb.index(end) + 1
            shown_groups.append(",".join(map(str, a.ids[at_a:to_a])) + "|" + ",".join(map(str, b[at_b:to_b])))
            at_a, at_b = to_a, to_b
        made.append((len(a.ids), len(b), links, shown_groups))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for m in made:
        if m is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, links, parts = m
        digest = hashlib.sha256(";".join(parts).encode()).hexdigest()
        out.append((n_a, n_b, len(parts), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out


@pytest.mark.parametrize("block", [1 << 10, 8 << 20])
def test_alignment_against_brute_force(spark, docs, empty, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    path_a, path_b, _ = paths()
    small = docs.where("length(text) < 10000 or text is null").coalesce(2)
    rows = small.collect()
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = sorted((str(r.doc_id), *(r[c] for c in columns)) for r in alignment.align(small, path_a, path_b).collect())
    assert got == sorted((str(r.doc_id), *x) for r, x in zip(rows, brute_alignment([r.text for r in rows]), strict=True))
    shown = {(r.doc_id, r.groups) for r in alignment.groups(small, path_a, path_b).collect()}
    assert {g and hashlib.sha256(g.encode()).hexdigest() for _, g in shown} == {x[-1] for x in got}
    assert alignment.align(empty, path_a, path_b).count() == 0
    assert alignment.align(docs, path_a, path_b).count() == docs.count()


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, words in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", words or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids, out = defaultdict(list), []
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        todo, leaves, saved = [p], 0, 0
        while todo:
            q = todo.pop()
            leaves += not kids[q]
            saved += (len(members[q]) - 1) * len(q[-1][1]) if q else 0
            todo += kids[q]
        return leaves, saved

    for p, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(full[c]) == len(p))))
        leaves, saved = below(p)
        up = min(members[p[:-1]]) if p else None
        out.append((min(ids), len(p), up, len(ids), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda x: x[:2])


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 400, 7), *range(100, 130), 0, 100, 200, 300, 5000, 5001]:
        # Few different turns, so that prefixes meet; some conversations are equal, long, or shorter than what they hand over.
        same = random.Random(c % 3 if rng.random() < 0.5 else c)
        rows += [(c, t, same.choice(["user", "", None]), same.choice(["yes", "no", None, "é日"])) for t in range(rng.choice([1, 1, 2, 5, 8, 9, 16, 17, 40]))]
    rows = list({(c, t): (c, t, r, w) for c, t, r, w in rows}.values())
    rows += [(7, None, "user", "first of all"), (None, 1, "user", "nobody's"), (-5, 0, "user", "below zero"), (9000, 3, "user", "gap"), (9000, 1, None, None)]
    chats = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, block string")
    turns, convs = prefix_trie.rebuilt(prefix_trie.turns_of(chats))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    for width in (8, 3):
        got = sorted((tuple(r[c] for c in columns) for r in prefix_trie.trie(turns, convs, width).collect()), key=lambda x: x[:2])
        assert got == brute_trie(rows)


def test_trie_cases(spark, monkeypatch):
    kind = "conv_id long, turn long, role string, text string"
    turns, convs = prefix_trie.rebuilt(prefix_trie.turns_of(spark.createDataFrame([], kind)))
    assert prefix_trie.trie(turns, convs).count() == 0
    # One long conversation, put in order and summed in several stretches, with a repeated row.
    monkeypatch.setattr(prefix_trie, "_STRETCH", 4)
    rows = [(c, 4096 * t, "user", f"{t}") for c in (1, 101) for t in range(90)] + [(1, 0, "user", "0")]
    turns, convs = prefix_trie.rebuilt(prefix_trie.turns_of(spark.createDataFrame(rows, kind)))
    got = sorted((r.conv_id, r.depth, r.n_convs, r.saved_tokens) for r in prefix_trie.trie(turns, convs, 2).collect())
    assert got == [(x[0], x[1], x[3], x[6]) for x in brute_trie(rows)]


def test_reduction_keeps_the_optimum():
    rng = random.Random(2)

    def optimum(items, capacity):
        best = len(items)

        def fill(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(items):
                best = len(bins)
                return
            for b in {x: n for n, x in enumerate(bins) if x + items[k] <= capacity}.values():
                bins[b] += items[k]
                fill(k + 1, bins)
                bins[b] -= items[k]
            fill(k + 1, [*bins, items[k]])

        fill(0, [])
        return best

    for _ in range(400):
        capacity = rng.choice([10, 13, 20, 30])
        low = rng.choice([1, capacity // 4, capacity // 3])
        items = sorted((rng.randint(low, capacity) for _ in range(rng.randint(1, 10))), reverse=True)
        left = np.bincount(items, minlength=capacity + 1).astype(np.int64)
        fixed = best_fit.reduce_instance(left, capacity)
        rest = np.repeat(np.arange(capacity + 1), left)[::-1].tolist()
        assert all(sum(s * n for s, n in p) <= capacity for _, p in fixed)
        assert sum(n for n, _ in fixed) + (optimum(rest, capacity) if rest else 0) == optimum(items, capacity)


@pytest.mark.parametrize("window", [16, 2048])
def test_best_fit_packing(docs, empty, window):
    from tokenizers import Tokenizer

    path = paths()[2]
    library = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.update((r.doc_id, k // window, k, tuple(ids[k : k + window])) for k in range(0, len(ids), window))
    rows = best_fit.pack(docs, path, window).collect()
    assert Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
    assert all(r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids) for r in rows)
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    assert len(filled) <= -(-sum(r.length for r in rows) // window) * 1.15 + 1
    assert best_fit.pack(empty, path, window).count() == 0
