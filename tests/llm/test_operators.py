"""Sharding, personal data, chat formatting, fingerprints and context mixing."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papercorpus.llm import chat, context_mixing, fingerprints, personal_data, queries, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TABLES = pytest.mark.parametrize("table", ["documents", "odd", "nothing"])


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@TABLES
@pytest.mark.parametrize("limit", [40_000, 300])
def test_sharding(table, limit, request):
    docs = request.getfixturevalue(table)
    rows = sharding.shard(docs, limit).collect()
    assert Counter((r["doc_id"], r["text_bytes"]) for r in rows) == Counter(
        (r["doc_id"], len((r["text"] or "").encode())) for r in docs.collect())
    held = defaultdict(list)
    for r in rows:
        assert len(r["shard"]) == r["depth"]
        held[r["shard"]].append(r)
    names = sorted(held)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    for name, group in held.items():
        size = sum(r["text_bytes"] for r in group)
        assert size == group[0]["shard_bytes"]
        assert size <= limit or len([r for r in group if r["text_bytes"]]) == 1
        if name:  # the shorter prefix was too large
            assert sum(r["text_bytes"] for r in rows if r["shard"].startswith(name[:-1])) > limit


def test_sharding_splits_one_id(spark):
    docs = spark.range(400).select(F.lit(5).alias("doc_id"), F.lit("x" * 10).alias("text"))
    rows = sharding.shard(docs, 500).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == 400 and max(sizes.values()) <= 50


def test_write_shards(documents, tmp_path, spark):
    sharding.write_shards(documents, str(tmp_path / "out"), 100_000)
    assert spark.read.parquet(str(tmp_path / "out")).drop("shard").exceptAll(documents).isEmpty()


def base_spans(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    found = []
    for number, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                    "card": 12 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in double) % 10 == 0,
                    "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), number, m.end()))
    return sorted(found)


@given(st.text(alphabet="ab1234.@+-() \n%é", max_size=60) | st.lists(st.sampled_from(
    ["1.2.3.4", ".5", "@", "a@b.c", "+12345678901", "4058826588634783", " ", "-", "d.e", "é", "\n", "256"]), max_size=12).map("".join))
def test_rules(text):
    assert personal_data.rule_spans(text) == base_spans(text)


@TABLES
def test_personal_data(table, request):
    docs = request.getfixturevalue(table)
    rows = personal_data.find_personal_data(docs).select("text", "personal.*").collect()
    assert len(rows) == docs.count()
    for r in rows:
        base = base_spans(r["text"] or "")
        assert r["base"] == personal_data.joined(base)
        assert Counter(personal_data.KINDS[k] for _, k, _ in base) == Counter(
            {k: r[f"n_{k}"] for k in personal_data.KINDS if r[f"n_{k}"]})
        spans = [x for x in r["spans"].split(",") if x]
        assert set(filter(None, r["base"].split(","))) <= set(spans) and len(spans) == len(base) + r["n_added"]


def test_field_finds_other_forms(spark):
    texts = ["please call (212) 555-0187 after six", "our office 646-555-0110 is open", "see pages 100-120 of 2019", "a total of 12 345 678 units",
             "released 2021-03-04 at 10:15", "nothing here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["spans"] for r in personal_data.find_personal_data(docs).select("doc_id", "personal.spans").collect()}
    assert found == {0: "phone:12:26", 1: "phone:11:23", 2: "", 3: "", 4: "", 5: ""}


def test_added_spans_miss_what_the_rules_found():
    draw = random.Random(4)
    text = "x" * 60
    for _ in range(300):
        base = sorted((a, draw.randrange(4), a + draw.randint(1, 12)) for a in draw.sample(range(48), draw.randint(0, 6)))
        chain = [(a, a + draw.randint(1, 3)) for a in range(0, 56, 4)]
        marks = np.array([draw.choice([0, 5]) for _ in chain])  # B-card
        digits = "".join("4" if any(a <= i < b for (a, b), m in zip(chain, marks, strict=True) if m) else "x" for i in range(60))
        found = [(a, 2, b) for (a, b), m in zip(chain, marks, strict=True) if m and personal_data.fits("card", digits[a:b])]
        expected = [s for s in found if not any(a < s[2] and s[0] < b for a, _, b in base)]
        assert personal_data.added_spans(digits, [chain], [marks], base) == expected
    one = "call (473) 555-8136 now " * 4000
    assert personal_data.added_spans(text, [], [], [(0, 1, 5)] * 4000) == [] and len(personal_data.rule_spans(one)) == 0


def test_long_words_are_read_whole():
    assert personal_data.shape("a" * 70 + "1@") == "xxxxd@"
    long = personal_data.features(["a" * 70 + "12345"])
    assert (long != personal_data.features(["a" * 75])).any()


def test_field_on_held_out_lines():
    rows = personal_data.labelled_rows()
    right = total = 0
    for part in range(4):
        weights, moves = personal_data.train([r for k, r in enumerate(rows) if k % 4 != part])
        for words, labels in (r for k, r in enumerate(rows) if k % 4 == part):
            got = personal_data.viterbi([personal_data.features(words)], weights, moves)[0]
            right, total = right + sum(got == labels), total + len(labels)
    assert right >= 0.85 * total


def label_spans(labels):
    """(first word, word after the last, kind) of each labelled span."""
    names = [personal_data.LABELS[x] for x in labels]
    starts = [i for i, name in enumerate(names) if name.startswith("B-")]
    return {(i, next((j for j in range(i + 1, len(names)) if not names[j].startswith("I-")), len(names)), names[i][2:]) for i in starts}


def test_spans_on_held_out_lines():
    """Precision and recall of whole spans by kind, each line labelled by a field that did not see it."""
    rows = personal_data.labelled_rows()
    right, found, there = Counter(), Counter(), Counter()
    for part in range(4):
        weights, moves = personal_data.train([r for k, r in enumerate(rows) if k % 4 != part])
        for words, labels in (r for k, r in enumerate(rows) if k % 4 == part):
            got = label_spans(personal_data.viterbi([personal_data.features(words)], weights, moves)[0])
            expected = label_spans(labels)
            for count, spans in ((right, got & expected), (found, got), (there, expected)):
                count.update(kind for _, _, kind in spans)
    f1 = {kind: 2 * right[kind] / (found[kind] + there[kind]) for kind in personal_data.KINDS}
    assert f1["ip"] >= 0.9 and f1["email"] >= 0.85 and f1["card"] >= 0.5 and f1["phone"] >= 0.35, (right, found, there)


def test_viterbi_is_best():
    draw = np.random.default_rng(1)
    weights, moves = draw.normal(size=(personal_data.DIMENSIONS, 3)).astype(np.float32), draw.normal(size=(3, 3)).astype(np.float32)
    chains = [draw.integers(0, personal_data.DIMENSIONS, (n, 9)) for n in (1, 4, 6, 2, 6)]
    for chain, got in zip(chains, personal_data.viterbi(chains, weights, moves), strict=True):
        score = weights[chain].sum(1)
        paths = np.array(np.meshgrid(*[range(3)] * len(chain), indexing="ij")).reshape(len(chain), -1).T
        values = score[np.arange(len(chain)), paths].sum(1) + moves[paths[:, :-1], paths[:, 1:]].sum(1)
        assert list(got) == list(paths[values.argmax()])


ODD_TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[/INST] \\[INST] [\\\\INST] <\\/s>["), (2, 1, "assistant", None), (2, 0, None, "x"),
    (3, 0, "a[ROLE]b\n", "[/ROLE]"), (3, 0, "a[ROLE]b\n", "[/ROLE]"), (4, None, "user", ""), (4, 3, "system", "s"),
    (None, 1, "system", "q"), (5, 0, "system", "s"), (5, 1, "user", "u" * 50_000), (5, 2, "assistant", "😀a"), (5, 2, "assistant", "b"),
    (6, 0, "system", "s"), (6, 1, "user", "u"), (6, 2, "assistant", "a"), (6, 3, "user", "u"), (6, 4, "assistant", "a"),
]


def test_chat_formatting(spark):
    turns = spark.createDataFrame([(*t, "x") for t in ODD_TURNS], "conv_id bigint, turn bigint, role string, text string, formatted string")
    rows = chat.format_chats(turns).withColumn("back", chat.read_back(F.col("formatted"))).collect()
    expected = defaultdict(list)
    for c, t, role, text in sorted(ODD_TURNS, key=lambda x: (x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        expected[c].append((role or "", text or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["back"]] for r in rows} == expected
    for r in rows:
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert r["n_turns"] == len(expected[r["conv_id"]])
    assert {r["conv_id"] for r in rows if r["valid"]} == {1, 6}
    assert chat.format_chats(turns.filter("turn > 99")).isEmpty()


def test_chat_escapes(values):
    texts = ["[INST]", "\\[INST]", "[\\INST]", "[[/INST]</s>", "plain", "<\\\\/s>", "[", ""]
    got = values([(t,) for t in texts], "t string", chat.escape(F.col("t")), chat.unescape(chat.escape(F.col("t"))))
    assert [b for _, b in got] == texts
    assert not any(c in e for e, _ in got for c in chat.DEFAULT.controls())


def test_chat_query(spark, folder):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    turns[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    rows = queries.op6_chat_formatting(spark, folder).collect()
    assert len(rows) == len(turns)
    for r in rows:
        own = sorted(turns[r["conv_id"]])
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), sha256("".join(f"{a}\n{t}\n" for _, a, t in own).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha256(loss.encode()).hexdigest())


def test_fingerprints(values):
    text = "one two three four\nfive six\n\nseven eight nine ten\nfive six"
    lines = text.split("\n")
    random.Random(1).shuffle(lines)
    rows = [(t,) for t in (text, "\n".join(lines), "five six", "one two three four\n\nseven eight nine ten\nfive six", None, "", "\n", "é", "é")]
    whole, mixed, part, less, none, empty, two, a, b = values(rows, "t string", fingerprints.fingerprint("t"))
    assert whole == mixed and none == empty and len({whole, part, less, empty, two, a, b}) == 7
    assert fingerprints.combine(less, part) == whole and fingerprints.combine(whole, part, remove=True) == less


def test_likeness_of_many_repeats():
    line = b"one two three"
    for n in (32_767, 32_768, 70_000):
        x, y = (tuple(v[0] for v in fingerprints.vectors([b"\n".join([line] * k)])) for k in (n, n + 1))
        assert fingerprints.likeness(x, y) == pytest.approx(1.0) and not np.array_equal(x[0], y[0])


def test_fingerprint_query(spark, odd, documents):
    sparse = documents.withColumn("doc_id", F.col("doc_id") * 1_000_003_000_000 - 2**60).unionByName(
        documents.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, 77)))
    for docs, blocks in ((documents, {"block": 7}), (odd, {"block": 7}), (odd, {"block": 3, "most": 1}), (odd.filter("doc_id > 1000"), {}),
                         (sparse, {"block": 20, "most": 30}), (sparse.filter("doc_id = 77"), {"most": 9})):
        rows = fingerprints.edited_fingerprints(docs, **blocks).collect()
        all_ = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        first = {}
        for i, t in all_:
            first.setdefault(i, t)
        ids = list(first)
        expected = Counter()
        for i, t in all_:
            following = first[ids[(ids.index(i) + 1) % len(ids)]]
            half = len(t) // 2
            expected[i, len(t), sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()] += 1
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == expected
        for r in rows:
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    usual = fingerprints.edited_fingerprints(documents).filter("n_chars > 200").agg(
        F.avg("near_edited"), F.avg("near_next")).first()
    assert usual[0] > 0.35 and usual[1] < 0.15


@TABLES
def test_base_scores(table, request):
    docs = request.getfixturevalue(table)
    rows = context_mixing.score_texts(docs).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    held = {i: crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in texts}
    counts = Counter(w for i, t in texts if not held[i] for w in [*WORD.findall(low(t)), "\n"])
    total, distinct = sum(counts.values()), len(counts)
    expected = defaultdict(list)
    for i, t in texts:
        words = [*WORD.findall(low(t)), "\n"]
        score = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        expected[i].append((len(words), sum(counts[w] > 0 for w in words), held[i], round(score, 6)))
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["n_tokens"], r["n_known"], r["held_out"], round(r["base_score"], 6)))
        assert r["train_tokens"] == total and -math.inf < r["score"] < 0
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}


def test_model_learns(documents):
    held = context_mixing.score_texts(documents).filter("held_out").agg(F.avg("bits_per_byte")).first()[0]
    assert held < 3.2


def test_bits_are_a_distribution():
    """Probabilities of all bytes after a prefix sum to one."""
    draw = np.random.default_rng(3)
    tables = draw.gamma(0.3, 4, (context_mixing.ORDERS, 2 << context_mixing.SLOT_BITS)).astype(np.float32)
    mixer = context_mixing.Mixer(draw.normal(0.3, 0.1, (context_mixing.GATES, context_mixing.ORDERS)))
    total = 0.0
    for last in range(256):
        bits = context_mixing.bits_of([b"ab" + bytes([last])])
        x, gate = context_mixing.inputs(bits, tables, None)
        odds, p = mixer.mixed(x, gate)
        q = mixer.probability(odds, p, gate)
        third = slice(bits.prefix[2] * 8, bits.prefix[2] * 8 + 8)
        total += float(np.prod(np.where(bits.ones == 1, q, 1 - q)[third]))
    assert total == pytest.approx(1, abs=1e-6)


WORDS = [context_mixing.END, b"a", b"ab", b"abacus", b"abc", "\u00e9t\u00e9".encode(), b"x" * 500, b"y"]
TIMES = np.array([9, 40, 1, 2, 3, 1, 2, 5])


def plain_bits(word: bytes):
    """(slots of the predictors, value) of each bit of a word and its closing space."""
    closed = word if word == context_mixing.END else word + b" "
    for n in range(1, len(closed) + 1):
        bits = context_mixing.bits_of([closed[:n]])
        place = bits.prefix[n - 1] * 8
        yield from zip(bits.slots[:, place : place + 8].T.tolist(), bits.ones[place : place + 8].tolist(), strict=True)


def plain_counts():
    counts = Counter()
    for word, times in zip(WORDS, TIMES.tolist(), strict=True):
        for slots, one in plain_bits(word):
            for k, slot in enumerate(slots):
                counts[k, slot * 2 + one] += times
    return counts


def test_contexts_are_counted_by_occurrence():
    table = pa.record_batch({"word": pa.array(WORDS, pa.binary()), "count": pa.array(TIMES)})
    got = np.zeros((context_mixing.ORDERS, 2 << context_mixing.SLOT_BITS))
    for batch in context_mixing.count_contexts(context_mixing.SLOT_BITS)(iter([table])):
        for row in batch.to_pylist():
            part = np.frombuffer(zlib.decompress(row["counts"]))
            got[row["k"], row["piece"] * 2 * context_mixing.PIECE :][: len(part)] = part
    expected = plain_counts()
    assert {(k, s): got[k, s] for k, s in zip(*np.nonzero(got), strict=True)} == expected


def test_bits_without_their_own_occurrence():
    """Predictions by shared prefixes equal those of each word by itself, one occurrence taken away."""
    counts = plain_counts()
    tables = np.zeros((context_mixing.ORDERS, 2 << context_mixing.SLOT_BITS), np.float32)
    for (k, slot), n in counts.items():
        tables[k, slot] = n
    mixer = context_mixing.Mixer()
    bits = context_mixing.bits_of(WORDS, TIMES)
    x, gate = context_mixing.inputs(bits, tables, np.ones(len(bits.ones), np.float32))
    odds, p = mixer.mixed(x, gate)
    q = mixer.probability(odds, p, gate)
    got = bits.by_word(np.log(np.where(bits.ones == 1, q, 1 - q)), len(WORDS))
    for word, log_p in zip(WORDS, got, strict=True):
        total = 0.0
        for slots, one in plain_bits(word):
            stretch, level = [], 0
            for k, slot in enumerate(slots):
                pair = [counts[k, slot * 2], counts[k, slot * 2 + 1]]
                pair[one] -= 1
                stretch.append(math.log((pair[1] + 0.1) / (pair[0] + 0.1)))
                if sum(pair):
                    level = 4 * k + sum(sum(pair) >= n for n in (2, 8, 64))
            z = max(-16, min(16, sum(stretch) / 3))
            place = min(max(z * 2 + 16, 0), 32 - 0.001)
            low = int(place)
            share = [1 / (1 + math.exp(-(i - 16) / 2)) for i in (low, low + 1)]
            near = share[0] * (low + 1 - place) + share[1] * (place - low)
            probability = min(max((1 / (1 + math.exp(-z)) + near) / 2, 1e-7), 1 - 1e-7)
            total += math.log(probability if one else 1 - probability)
        assert log_p == pytest.approx(total, rel=1e-4, abs=1e-4)


def test_fewer_places(documents):
    """Contexts share places, and the scores stay those of a model."""
    rows = context_mixing.score_texts(documents.limit(50), slot_bits=10).select("score", "bits_per_byte").collect()
    assert len(rows) == 50 and all(-math.inf < r["score"] < 0 < r["bits_per_byte"] for r in rows)
