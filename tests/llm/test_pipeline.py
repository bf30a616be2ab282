"""The whole pipeline against plain Python, stage by stage, with its defined cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_llm_operators import brute_components, brute_counts
from tokenizers import Tokenizer

import corpus_pipeline
from shelfsense.llm import packing

KIND = "doc_id long, text string, lang string, source string, n_chars long, _row string, component string, score string"
SHARED = "This very passage stands in many of the documents and is long enough to go"


def sample():
    rng = random.Random(11)
    pool = [f"w{k}" for k in range(400)] + ["É", "日本", "naïve", "x\x0by"]

    def text(n):
        return " ".join(rng.choices(pool, k=n))

    rows = {k: text(rng.choice([12, 60, 200])) for k in range(30)}
    rows |= {30: None, 31: "", 32: "few words", 33: "again and again " * 20, 34: text(9000), 35: "\n\n" + text(30) + "\n\n"}
    for k in range(40, 48):
        rows[k] = f"{text(40)}\n  {SHARED.upper() if k % 2 else SHARED}\t\n{text(40)}"
    near = text(150)
    for k in range(50, 58):
        ws = near.split()
        ws[7 * (k - 50)] = f"other{k}"
        rows[k] = " ".join(ws)
    rows[60] = rows[61] = rows[2]
    # Only without the shared line are these alike.
    for k, last in ((70, ""), (71, "")):
        rows[k] = f"{rows[5]} tail of some words\n{SHARED}{last}"
    return rows


def brute(rows):
    good = {}
    for k, t in rows.items():
        n_words, *_, repeated = brute_counts(t)
        if n_words >= 10 and 100 * repeated <= 20 * n_words:
            good[k] = t
    keys = {k: [re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)}) for line in t.split("\n")] for k, t in good.items()}
    holders = defaultdict(set)
    for k, own in keys.items():
        for key in own:
            holders[key].add(k)
    gone = {key: max(own) for key, own in holders.items() if len(key) >= 40 and len(own) >= 5}
    clean = {k: "\n".join(line for line, key in zip(t.split("\n"), keys[k], strict=True) if gone.get(key, k) == k) for k, t in good.items()}
    _, root = brute_components(list(clean.items()))
    return {k: t for k, t in clean.items() if root[k] == k}


def write(spark, folder, rows):
    spark.createDataFrame([(k, t, "en", "s", 1, "r", "c", "s") for k, t in rows], KIND).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("repeats", [(), (3, 34)])
def test_pipeline_against_brute_force(spark, tmp_path, repeats):
    rows = sample()
    kept = brute(rows)
    assert {30, 31, 32, 33, 51, 57, 60, 61}.isdisjoint(kept) and {2, 34, 50} <= kept.keys() and SHARED.lower() not in kept[40].lower()
    got = corpus_pipeline.run(spark, write(spark, tmp_path, [*rows.items(), *((k, rows[k]) for k in repeats)])).collect()
    encoder = Tokenizer.from_file(packing.vocabulary())
    pieces, sequences = defaultdict(Counter), defaultdict(list)
    ids = {k: np.array([*encoder.encode(t, add_special_tokens=False).ids, 2], "<u4") for k, t in kept.items()}
    for r in got:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.length > 0 and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].update(range(r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces == {k: Counter({at: 1 + (k in repeats) for at in range(len(own))}) for k, own in ids.items()}
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [])).count() == 0
