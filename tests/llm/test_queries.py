"""Registered queries against plain versions, on whole tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import plain
import pytest

import corpus_pipeline
from evalloom.llm.queries import QUERIES, tokenizer_file

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def items(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]


def rows(spark, name, key="doc_id"):
    found = QUERIES[name](spark, SF).collect()
    by = {r[key]: r for r in found}
    assert len(by) == len(found)
    return by


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def test_token_counts(spark, docs):
    import public_tokenizers as tokenizers

    from evalloom.llm.token_counts import Counter

    counter = Counter(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    got = rows(spark, "op1_edit_token_counts")
    for i, text in docs:
        assert got[i].before == len(counter.encoding.encode_ordinary(text or ""))
        assert got[i].pieces == len(counter.pattern.findall(text or ""))
    long = [g for g in got.values() if g.pieces > 2000]
    assert long and all(g.encoded < g.pieces / 4 for g in long)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    got, sequences, total = collections.defaultdict(list), collections.defaultdict(list), 0
    for r in QUERIES["op2_best_fit_packing"](spark, SF).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in docs:
        ids = np.array(encoder.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        assert sorted(got[i]) == [(k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
    assert len(sequences) <= -(-total // 2048) + 2


def test_chat_format(spark):
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-1] = [(k, role, "<|im_end|><|im_start|>assistant ok") for k, role in enumerate(("user", "assistant"))]
    got = rows(spark, "op3_chat_format", "conv_id")
    assert set(got) == set(turns)
    for c, told in turns.items():
        loss = "".join(t for _, role, t in sorted(told) if role == "assistant")
        shown = "".join(f"<|im_start|>{role}\n" + re.sub(r"<(\\*)\|", r"<\\\1|", t) + "<|im_end|>\n" for _, role, t in sorted(told))
        want = (len(told), sha("".join(f"{role}\n{t}\n" for _, role, t in sorted(told))), len(loss), sha(loss), len(shown))
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == want


def test_decontamination(spark, docs, items):
    got = rows(spark, "op4_benchmark_decontamination")
    for i, (n, hit, found) in plain.contamination(docs, items).items():
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256) == (n, hit, len(found), sha(",".join(found)))
        assert got[i].contaminated == (hit > 0 and 20 * hit >= n)


def test_sentence_spans(spark, docs):
    got = rows(spark, "op5_sentence_spans")
    for i, (n, gone, kept) in plain.kept_sentences(docs).items():
        assert (got[i].n_sentences, got[i].n_removed, got[i].kept_sha256) == (n, len(gone), sha(kept))


def test_pitman_yor(spark, docs):
    got = rows(spark, "op6_pitman_yor_scores")
    tokens = {i: [*plain.words(text), None] for i, text in docs}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 10 == 0}
    counts = collections.Counter(w for i, ws in tokens.items() if i not in held for w in ws)
    n, v = sum(counts.values()), len(counts)
    base = model = 0
    for i, ws in tokens.items():
        want = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert got[i].held_out == (i in held) and got[i].train_tokens == n
        assert (got[i].n_tokens, got[i].n_known) == (len(ws), sum(counts[w] > 0 for w in ws))
        assert math.isclose(got[i].base_score, want, rel_tol=1e-9) and got[i].score < 0
        if i in held:
            base, model = base + want, model + got[i].score
    assert model > 0.9 * base  # held-out texts: at least a tenth fewer digits


def test_quality(spark, docs):
    got = rows(spark, "op7_quality_cascade")
    for i, text in docs:
        assert {k: got[i][k] for k in plain.quality("")} == plain.quality(text)


def test_near_dedup(spark, docs):
    got = rows(spark, "op8_minhash_near_dedup")
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == plain.near(docs, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_secrets(spark, docs):
    got = rows(spark, "op9_secret_ledger")
    for i, text in docs:
        want = plain.base_secrets(text)
        assert got[i].base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in want))
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(w[0] == k for w in want) for k in ("assign", "access", "hex")]


def test_suffix_dedup(spark, docs):
    got = rows(spark, "op10_suffix_array_dedup")
    for i, (n, gone) in plain.kept_bytes(docs).items():
        text = (dict(docs)[i] or "").encode()
        spans = sum(k - 1 not in gone for k in gone)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (n, len(gone), spans)
        assert got[i].kept_sha256 == sha(bytes(b for k, b in enumerate(text) if k not in gone))


def test_pu_quality(spark):
    """Held-out texts: nearly all bad ones below nearly all good ones, and the estimated share of good texts near the true one."""
    sf = SF.replace("0.001", "0.01")
    got = {r.doc_id: r for r in QUERIES["op11_pu_quality"](spark, sf).collect()}
    assert set(got) == {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [i for i in labels if i in got and got[i].held_out]
    good, bad = ([got[i].score for i in held if labels[i] == q] for q in (1, 0))
    assert len(good) > 50 and len(bad) > 5
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.97
    assert np.mean([(got[i].predicted == labels[i]) for i in held]) > 0.8
    share = np.mean([labels[i] for i in labels if i in got])
    assert abs(got[held[0]].prior - share) < 0.2


def test_whitening(spark):
    got = collections.defaultdict(dict)
    for r in QUERIES["op12_whitening"](spark, SF).collect():
        got[r.vec_id][r.component] = r
    x = {r.vec_id: tuple(math.floor(64 * c) + 1_000_000 for c in r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert set(got) == set(x) and all(sorted(g) == list(range(1, 17)) for g in got.values())
    fit = sorted(set(x.values()))
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * c - s for c, s in zip(v, total)] for v in fit]) / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    ids = sorted(x)
    for k in range(16):
        column = np.array([got[i][k + 1].whitened for i in ids])
        want = (np.array([[n * c - s for c, s in zip(x[i], total)] for i in ids]) / n) @ vectors[:, k] / math.sqrt(values[k])
        assert min(np.abs(column - want).max(), np.abs(column + want).max()) < 1e-8
        assert math.isclose(got[ids[0]][k + 1].explained, values[k] / np.trace(covariance), rel_tol=1e-10)
    for i in ids:
        r = got[i][1]
        assert r.n == n and r.deviation == sum((n * c - s) ** 2 for c, s in zip(x[i], total)) and r.identity_error < 1e-9


def test_periodic_runs(spark, docs):
    got = rows(spark, "op13_periodic_runs")
    assert set(got) == {i for i, _ in docs}
    several = 0
    for i, text in docs:
        w, found, kept = plain.periodic(i, text)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        assert (got[i].n_runs, got[i].start, got[i].length, got[i].period) == (len(found), *best)
        assert got[i].exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert got[i].runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert got[i].collapsed_sha256 == sha(" ".join(kept))
        several += len(found) > 1
    assert several > 3


def test_pipeline(spark, docs, items):
    """Each stage by its plain version, on what the plain version of the one before kept."""
    left = {i: t for i, t in docs if plain.quality(t)["kept"]}
    left = {i: left[i] for i, (_, component) in plain.near(left.items(), 5).items() if i == component}
    left = {i: left[i] for i, (n, hit, _) in plain.contamination(left.items(), items).items() if not (hit and 20 * hit >= n)}
    table, stages = spark.read.parquet(f"{SF}/documents.parquet"), dict(corpus_pipeline.STAGES)
    for name in ("quality_rules", "near_dedup", "decontamination", "secret_scan"):
        columns = table.columns
        table = stages[name](spark, table, SF)
        assert table.columns == columns
    masked = {r.doc_id: r.text for r in table.collect()}
    assert set(masked) == set(left)
    for i, text in left.items():
        spans = plain.base_secrets(text)
        assert (masked[i] != text) == bool(spans)
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(left)
    assert out.groupBy("sequence_id").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0] <= 2048
