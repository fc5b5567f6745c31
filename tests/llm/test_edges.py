"""Nulls, empty and long texts, repeats, ties, empty tables and clashing column names."""

import hashlib

import plain
import pytest
from pyspark.sql import functions as F

from evalloom.llm import chat, decontamination, near_dedup, packing, pitman_yor, quality, secret_ledger, sentence_dedup, suffix_dedup, token_counts
from evalloom.llm.queries import tokenizer_file

LONG = " ".join(f"w{k * k % 9973}" for k in range(20_000)) + "."
PASSAGE = "This passage stands in several documents, word for word; it has clauses, a few sentences, and enough words. Yes, it does, and here are a few more of them to be sure."
ROWS = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One"), (5, LONG), (6, LONG + " more"), (7, PASSAGE), (8, "Before it. " + PASSAGE + " After it."),
    (9, "naïve “ünïcödé” 漢字 text\x00 with\x1cseparators and more <|endoftext|>"), (10, "token=secret1 " * 3), (11, "x" * 5000), (None, PASSAGE), (12, PASSAGE), (12, PASSAGE), (13, "a b c d e"), (13, "f g h i j k"),
]
NAMED = [(i, t) for i, t in ROWS if i is not None and i < 12]


@pytest.fixture(scope="module")
def docs(docs_of):
    return docs_of(ROWS)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, "one"), (3, None), (4, ""), (None, "w1 w4 w9"), (5, "...")], "item_id long, text string")


def test_token_counts(spark, docs, empty):
    import public_tokenizers as tokenizers

    path, pattern = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN
    edit = lambda a, b, t: F.struct(F.lit(a).cast("int").alias("start"), F.lit(b).cast("int").alias("end"), F.lit(t).cast("string").alias("text"))
    edits = F.array(edit(3, 5, "new words"), edit(10**6, 10**7, " at the end"), edit(None, None, None), edit(-4, 2, ""))
    counter = token_counts.Counter(path, pattern)
    out = token_counts.count_tokens(docs, edits, path, pattern)
    for r in out.collect():
        assert r.counts.after == len(counter.encoding.encode_ordinary(r.text)) == r.tree.tokens[1]
    again = token_counts.count_tokens(out.drop("counts"), F.array(edit(0, 0, "x ")), path, pattern)
    for r in again.collect():
        assert r.counts.pieces == 0 and r.counts.after == len(counter.encoding.encode_ordinary(r.text))
    assert out.columns == [*docs.columns, "tree", "counts"]
    assert token_counts.count_tokens(empty, edits, path, pattern).count() == 0
    assert token_counts.count_tokens(docs, F.lit(None), path, pattern).where("counts.before <> counts.after").count() == 0


def test_tree_after_random_edits():
    import random

    import public_tokenizers as tokenizers

    counter, rnd = token_counts.Counter(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN), random.Random(5)
    for _ in range(150):
        text = "".join(rnd.choice("ab  \n'1.é") for _ in range(rnd.randint(0, 400)))
        tree = token_counts.Tree.over(*counter.leaves(counter.pattern.findall(text)))
        for _ in range(5):
            a = rnd.randint(0, len(text))
            text, tree, _ = token_counts.edited(counter, text, tree, a, a + rnd.choice([0, 1, 5, 60]), rnd.choice(["", " ", "\n\n ", "'s", "x1 " * 90]))
            assert (tree.tokens[1], tree.chars[1]) == (len(counter.encoding.encode_ordinary(text)), len(text))


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    encoder = Tokenizer.from_file(path)
    out = packing.pack_documents(docs, path, keep_ids=True).collect()
    want = sorted(len(encoder.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)
    ids = {}
    for r in out:
        ids.setdefault((r.doc_id, r.start if r.doc_id == 5 else 0), []).append(r)
    assert sum(r.length for r in out) == sum(want) and max(r.length for r in out) == 2048
    nine = next(r for r in out if r.doc_id == 9)
    assert nine.ids == [*encoder.encode(ROWS[9][1], add_special_tokens=False).ids, 0]
    ends = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert packing.pack_documents(empty, path).count() == 0
    bad = spark.createDataFrame([(0,), (2049,), (None,)], "length long")
    for k in range(3):
        with pytest.raises(Exception, match="no length of a piece"):
            packing.pack(bad.limit(k + 1).subtract(bad.limit(k))).collect()


def test_plans_fill_sequences():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(40):
        capacity = int(rng.choice([8, 64, 256]))
        counts = np.zeros(capacity + 1, np.int64)
        counts[rng.integers(1, capacity + 1, rng.integers(0, capacity))] = rng.integers(1, 300)
        plan = packing.Plan(counts, capacity, int(rng.integers(1, 9)))
        key, sequence, offset = plan.arrays()
        fill = {}
        for n in np.flatnonzero(counts):
            k = (int(n) << 48) + np.arange(counts[n])
            run = np.searchsorted(key, k, "right") - 1
            for s, o in zip(sequence[run] + k - key[run], offset[run], strict=True):
                fill.setdefault(int(s), []).append((int(o), int(n)))
        assert len(fill) == plan.sequences
        for parts in fill.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= capacity


def test_chat_events(spark):
    log = [
        ("c", 1, 1, "delta", "user", "Hi "), ("c", 2, 1, "delta", None, "<|im_end|>"), ("c", 3, 2, "delta", "assistant", "No"), ("c", 4, 2, "delta", "assistant", "pe"),
        ("c", 5, 3, "delta", "user", "Why?"), ("c", 6, 2, "regenerate", "assistant", ""), ("c", 7, 2, "delta", "assistant", "Yes\\<|"), ("c", 8, 1, "edit", "user", "Hello "), ("c", 9, 1, "delta", "user", "<\\|x"),
        ("c", 10, 4, "delta", "ro\nle\\n", None), (None, 1, 1, "delta", None, None), ("c", 10, 5, "delta", "assistant", "tie"),
    ]
    events = spark.createDataFrame(log, "conv_id string, seq long, message long, kind string, role string, text string")
    out = {r.conv_id: r for r in chat.format_chats(events).select("conv_id", chat.read_back(chat.formatted(F.col("segments"))).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), chat.formatted(F.col("segments")).alias("shown")).collect()}
    assert [(t.role, t.text) for t in out["c"].turns] == [("user", "Hello <\\|x"), ("assistant", "Yes\\<|"), ("ro\nle\\n", ""), ("assistant", "tie")]
    assert out["c"].loss == "Yes\\<|tie" and out["c"].shown.count("<|im_start|>") == 4
    assert [(t.role, t.text) for t in out[None].turns] == [("", "")]
    assert chat.format_chats(events.where("false")).count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        chat.format_chats(events.withColumn("kind", F.lit("gone"))).collect()
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None)], "conv_id long, turn long, role string, text string")
    assert chat.fold(chat.turn_events(turns)).count() == 3


def test_decontamination(docs, empty, items):
    found = decontamination.scan_benchmark(docs.drop("scan"), items).collect()
    want = plain.contamination([(k, t) for k, (_, t) in enumerate(ROWS)], [(i if i is not None else "", t) for i, t in items.collect()])
    got = sorted((r.scan.n_words, sum(x.end - x.start for x in r.scan.runs), tuple(r.scan["items"])) for r in found)
    assert got == sorted((n, hit, tuple(x)) for n, hit, x in want.values())
    assert any(r.n_words == len(plain.words(PASSAGE, plain.ALNUM)) for f in found for r in f.scan.runs if r.item_id == "1")
    blocks = decontamination.scan_benchmark(docs.drop("scan"), items, block_bytes=60).collect()
    assert sorted((sum(x.end - x.start for x in r.scan.runs), tuple(r.scan["items"])) for r in blocks) == sorted(x[1:] for x in got)
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2, 5, 6, 9, 10, 11, 13}
    assert decontamination.decontaminate(empty, items).count() == 0
    assert decontamination.decontaminate(docs, items.where("false")).count() == len(ROWS)
    with pytest.raises(ValueError):
        decontamination.scan_benchmark(docs, items)


def test_sentence_spans(docs, empty):
    out = sentence_dedup.remove_repeated_spans(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == [*docs.columns, "passages"]
    for i, (n, gone, kept) in plain.kept_sentences(NAMED).items():
        assert (got[i].passages.n_sentences, got[i].passages.n_removed, got[i].text or "") == (n, len(gone), kept)
    assert got[0].text is None and got[8].text.startswith("Before it.") and PASSAGE[:40] not in got[8].text
    assert got[12].passages.n_removed > 0 and got[None].passages.n_removed > 0
    assert sentence_dedup.remove_repeated_spans(empty).count() == 0


def test_pitman_yor(docs, empty):
    out = pitman_yor.score_texts(docs, F.col("doc_id") == 5).collect()
    assert len(out) == len(ROWS)
    for i, t in ROWS:
        assert any(r.doc_id == i and r.n_tokens == len(plain.words(t)) + 1 and r.score < 0 for r in out)
    assert pitman_yor.score_texts(empty, F.lit(False)).count() == 0
    none = pitman_yor.score_texts(docs, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in none)


def test_restaurants_sum_to_one():
    import numpy as np

    level = pitman_yor.Level(np.array([1, 2, 3, 256 + 1]) | 1 << 56, np.array([5, 1, 300, 7]))
    stirling, rng = pitman_yor.log_stirling(pitman_yor.LETTER_DISCOUNT), np.random.default_rng(0)
    parent = np.full(4, 1 / 256)
    level.draw(level.direct, parent, rng, stirling)
    assert (level.tables >= 1).all() and (level.tables <= level.direct).all()
    guess, left = level.predict(parent)
    unseen = 1 - np.bincount(level.context, parent)
    assert np.allclose(np.bincount(level.context, guess) + left * unseen, 1)


def test_joined_model_scores_like_the_sent_one(spark, monkeypatch):
    words = spark.createDataFrame([(w, 1) for w in ("then", "there", "these", "thin", "tin", "a", "né", "ñandú")], "word string, tables long")
    model, shared = pitman_yor.letter_model(words, None, 1)
    asked = spark.createDataFrame([("then",), ("zzz",), ("thine",), ("né",), ("ab",), ("x",)], "word string")
    sent = {r.word: r.spelling for r in pitman_yor.with_spelling(asked, model, shared).collect()}
    monkeypatch.setattr(pitman_yor, "BROADCAST_CELLS", 0)
    joined = {r.word: r.spelling for r in pitman_yor.with_spelling(asked, model, shared).collect()}
    assert sent.keys() == joined.keys() and all(abs(sent[w] - joined[w]) < 1e-9 for w in sent)


def test_quality(docs, empty):
    kept = quality.keep_quality(docs)
    want = sorted((i is None, i or 0) for i, t in ROWS if plain.quality(t)["kept"])
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == want and kept.columns == docs.columns
    assert quality.keep_quality(empty).count() == 0
    stats = {r.doc_id: r.s for r in quality.measured(docs, "text", "s").collect()}
    for i, t in NAMED:
        assert {k: v for k, v in plain.quality(t).items() if k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}.items() <= stats[i].asDict().items()
    order = quality.cascade_order(docs, quality.standard_rules())
    assert {n for n, _, _ in order} == set(quality.standard_rules())
    rates = [share / seconds for _, seconds, share in order]
    assert rates == sorted(rates, reverse=True)
    with pytest.raises(ValueError):
        quality.cascade(docs, quality.standard_rules(), into="found")


def test_near_dedup(docs, empty, docs_of):
    got = {}
    for r in near_dedup.near_duplicates(docs, words=4).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, (n, component) in plain.near(NAMED, 4).items():
        assert (got[i][0].n_shingles, got[i][0].component_id) == (n, component)
    assert [r.component_id for r in got[12]] == [7, 7] and not any(r.kept for r in got[12])
    assert got[None][0].component_id is None and got[None][0].kept
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {3, 5, 7, 13, None} <= {r.doc_id for r in kept.collect()}
    assert near_dedup.near_duplicates(empty).count() == 0
    # a chain: each text is near the next only, and a large group around one text
    base = [f"t{k}" for k in range(120)]
    rows = [(k, " ".join(base[: 100 + k])) for k in range(20)] + [(100 + k, " ".join([*base[:k], f"other{k}", *base[k:]])) for k in range(100)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs_of(rows), words=4).collect()}
    assert got == {i: c for i, (_, c) in plain.near(rows, 4).items()}


def test_secrets(docs, empty):
    found, ledger = secret_ledger.scan(docs)
    for r in found.collect():
        assert [(s.kind, s.start, s.end) for s in r.secrets] == plain.base_secrets(r.text)
    rows = ledger.count()
    assert rows == len({hashlib.sha256((t or "").encode()).hexdigest() for _, t in ROWS}) * len(secret_ledger.RULES)
    again, same = secret_ledger.scan(docs, ledger)
    assert same.count() == rows and sorted(map(str, again.select("doc_id", "secrets").collect())) == sorted(map(str, found.select("doc_id", "secrets").collect()))
    newer = (*secret_ledger.RULES[1:], secret_ledger.Rule("assign", secret_ledger.RULES[0].pattern, 2, 100, version=2))
    later, more = secret_ledger.scan(docs, ledger, newer)
    assert more.count() == rows + rows // len(secret_ledger.RULES) and later.where("size(secrets) > 0").count() == 0
    masked = secret_ledger.mask_secrets(docs)
    assert masked.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in masked.collect()}[10] == ("[assign] " * 3, 27)
    assert secret_ledger.mask_secrets(empty).count() == 0


def test_secrets_take_each_other(docs_of):
    texts = ["secret=token: abcdef", "a" * 24 + "Z" + "0" * 23, "AKIA" + "B" * 16 + " AKIA", 'API_key"  : "q1w2e3"', "é" * 9 + "password=abcdef", "api-key=abcdef"]
    rows = list(enumerate(texts))
    for r in secret_ledger.scan(docs_of(rows))[0].collect():
        assert [(s.kind, s.start, s.end) for s in r.secrets] == plain.base_secrets(r.text)


def test_suffix_dedup(docs, empty, docs_of):
    for options in ({}, {"chunk_bytes": 3000, "entries": 50, "batches": 7}):
        got = {}
        for r in suffix_dedup.remove_repeated_strings(docs, **options).collect():
            got.setdefault(r.doc_id, []).append(r)
        for i, (n, gone) in plain.kept_bytes(NAMED).items():
            text = (dict(NAMED)[i] or "").encode()
            assert (got[i][0].n_bytes, got[i][0].n_removed, bytes(got[i][0].kept)) == (n, len(gone), bytes(b for k, b in enumerate(text) if k not in gone))
        assert [r.n_removed for r in got[12]] == [len(PASSAGE)] * 2 and got[None][0].n_removed == len(PASSAGE)
    assert suffix_dedup.remove_repeated_strings(empty).count() == 0
    edge = "".join(chr(97 + k * k % 26) for k in range(200))
    rows = [(1, edge[:49]), (2, edge[:50]), (3, "é" + edge[:50]), (4, edge[10:70]), (5, edge[100:149] + edge[:49]), (6, "ab" * 60), (7, "ab" * 40)]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeated_strings(docs_of(rows), chunk_bytes=60).collect()}
    assert got == {i: len(gone) for i, (_, gone) in plain.kept_bytes(rows).items()}


def test_words_are_encoded_many_at_once_and_kept():
    """A call of the tokenizer takes many words, and what comes again is not encoded again when others are forgotten."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeéß,.'") for _ in range(rnd.randint(4, 9)))
    common, given = [word() for _ in range(100)], []

    class Counted:
        def __init__(self, encoder):
            self.encoder = encoder

        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return self.encoder.encode_batch_fast(texts, **options)

    path = tokenizer_file("word_bpe_49k.json")
    memo, whole = packing.WordIds(path), Tokenizer.from_file(path)
    memo.encoder = Counted(memo.encoder)
    packing.REMEMBERED, before = 1000, packing.REMEMBERED
    try:
        for turn in range(6):
            texts = [" ".join([*common, *(word() for _ in range(400))]) for _ in range(2)]
            given.clear()
            for text, ids in zip(texts, memo.encode(pa.array(texts)), strict=True):
                assert ids.tolist() == [*whole.encode(text, add_special_tokens=False).ids, 0]
            assert 1 <= len(given) <= 2
            assert turn < 1 or not set(common) & {w for text in given for w in text.split()}
        assert len(memo.slot) < 2000
    finally:
        packing.REMEMBERED = before
    odd = ["", None, " ", "\x01", "a \x01 b", "a\x01", "\x01 " * 3, "x\x1cy\x85z q  　r", "́ é H̱ İI ΑΣ", "it's 'Sa <|endoftext|>b <|ENDOFTEXT|>", "\t\v\fa\r\n", "漢字 12３ ½"]
    for texts in (odd, odd[:3], []):
        found = packing.WordIds(path).encode(pa.array(texts, pa.string()))
        assert [ids.tolist() for ids in found] == [[*whole.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
