"""The registered queries over the whole smallest tables, each against its brute-force version."""

import hashlib
import os
import zlib

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def rows(spark):
    return sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


def test_op1(spark, rows):
    from test_secret_crf import plain

    from tessera.llm.queries import op1_secret_crf

    got = {r["doc_id"]: r for r in op1_secret_crf(spark, SF).collect()}
    assert set(got) == {k for k, _ in rows}
    for k, t in rows:
        want = plain(t or "")
        assert [s for s in got[k]["spans"].split(",") if s and not s.startswith("crf")] == want
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        counts = [sum(s.startswith(f"{n}:") for s in want) for n in ("assign", "access", "hex")]
        assert [got[k][c] for c in ("n_assign", "n_access", "n_hex")] == counts


def test_op2(spark, rows):
    from tessera.llm.queries import op2_decontaminate

    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in op2_decontaminate(spark, SF).collect()}
    exact = {(k, i) for k, t in rows for i, x in items.items() if t and x and x in t}
    assert exact <= got and exact


def test_op4(spark, rows):
    from test_simhash_near import brute

    from tessera.llm.queries import op4_simhash_near

    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op4_simhash_near(spark, SF).collect()}
    assert got == brute(rows)


def test_op5(spark, rows):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from tessera.llm.queries import op5_token_files

    tokenizer, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    got = {r["doc_id"]: r for r in op5_token_files(spark, SF).collect()}
    for k, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op6(spark, rows):
    from test_suffix_dedup import brute

    from tessera.llm.queries import op6_suffix_dedup

    got = sorted(tuple(r) for r in op6_suffix_dedup(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == brute(rows)


def test_op7(spark, rows):
    from test_fingerprints import plain

    from tessera.llm.queries import op7_fingerprints

    got = {r["doc_id"]: r for r in op7_fingerprints(spark, SF).collect()}
    prints = [plain(t or "") for _, t in rows]
    for i, (k, t) in enumerate(rows):
        t, other = t or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + other[:q]
        assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[k]["n_chars"] == len(t)
        assert got[k]["fingerprint"] == f"{prints[i]:016x}" and got[k]["edited_fingerprint"] == f"{plain(edited):016x}"
        assert got[k]["near_next"] == 1 - (prints[i] ^ prints[(i + 1) % len(rows)]).bit_count() / 64


def test_op9(spark, rows):
    import re

    from tessera.llm.mixing import WEIGHTS, targets
    from tessera.llm.queries import op9_mix_sources

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").collect()]
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, _, t in docs}
    source = {k: s for k, s, _ in docs}
    names = sorted(set(source.values()), key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size[k] for k in size if source[k] == s) for s in names}
    goal = dict(zip(names, targets([total[s] for s in names], [WEIGHTS[i % 3] for i in range(len(names))]), strict=True))
    got = {r["doc_id"]: r for r in op9_mix_sources(spark, SF).collect()}
    assert set(got) == set(size) and sum(goal.values()) == pytest.approx(sum(size.values()))
    for k, r in got.items():
        assert r["size"] == size[k] and r["source_size"] == total[source[k]] and r["target"] == pytest.approx(goal[source[k]])
        assert r["taken"] % max(1, size[k]) == 0 and 0 <= r["taken"] <= 3 * size[k]
    for s in names:
        own = [k for k in size if source[k] == s]
        assert abs(sum(got[k]["taken"] for k in own) - goal[s]) <= max(size[k] for k in own)
    assert {k: r["taken"] for k, r in got.items()} == {r["doc_id"]: r["taken"] for r in op9_mix_sources(spark, SF).collect()}
