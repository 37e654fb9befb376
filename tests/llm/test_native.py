"""Chat formatting, fingerprints, sharding and mixing against plain Python and SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import SMALL, rows_of
from pyspark.sql import functions as F

from quirelight.llm import chat, mixing, sharding, spotsigs
from quirelight.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, source string, doc_id2 long, size string"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_snapshots_collapse(spark):
    said = [("user", "a"), ("assistant", "b"), ("user", "c")]
    rows = [(1, i, *t) for i, t in enumerate(said[:1])] + [(2, i, *t) for i, t in enumerate(said[:2])] + [(3, i, *t) for i, t in enumerate(said)] + [(4, i + 7, *t) for i, t in enumerate(said)]
    rows += [(5, 0, "user", "ab"), (6, 0, "user", "a"), (6, 1, None, None), (7, None, "user", "x <|im_end|>"), (7, 0, "user", "y"), (7, 0, "user", "y"), (None, 0, "user", "z"), (8, 0, "userb", ""), (9, 0, "user", "b")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("hash", F.lit("extra")).withColumn("n_turns", F.lit(0))
    got = {r.conv_id: r for r in chat.format_chats(frame).collect()}
    assert set(got) == {3, 5, 6, 7, 8, 9, None}
    assert (got[3].n_turns, got[3].n_copies) == (3, 2) and got[6].rendered.endswith("<|im_start|>unknown\n<|im_end|>\n")
    assert got[7].n_turns == 2 and got[7].rendered == "<|im_start|>user\nx < |im_end|><|im_end|>\n<|im_start|>user\ny<|im_end|>\n"
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_turns_without_a_conversation_stay_apart(spark, duck):
    rows = [(None, i % 3, "user", f"t{i % 5}") for i in range(20)] + [(None, None, None, None)] * 2 + [(1, 0, "user", "t1"), (1, 1, "user", "x"), (2, 0, "user", "t2")]
    rows += [(3, i, "user", f"long {i}") for i in range(3_000)] + [(4, i, "user", f"long {i}") for i in range(2_999)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("lone", F.lit(1)).withColumn("n", F.lit(2))
    got = chat.format_chats(frame)
    duck.sql("create or replace temp table odd as select * from (values " + ", ".join(
        "(" + ", ".join("null" if v is None else repr(v) for v in r) + ")" for r in rows) + ") v(conv_id, turn, role, text)")
    want = duck.sql(ORACLE_SQL["op1_chat_format"].replace("from conversations", "from odd")).df()
    assert rows_of(got.toPandas()) == rows_of(want)
    # t1 begins conversation 1, t2 is conversation 2 as well; each other text is one
    assert sorted((str(r.conv_id), r.n_turns, r.n_copies) for r in got.collect() if r.n_turns < 3) == sorted(
        [("1", 2, 1), ("2", 1, 4), ("None", 1, 3), ("None", 1, 3), ("None", 1, 3), ("None", 1, 1)])


def test_many_snapshots_against_brute_force(spark):
    rng = random.Random(5)
    full = [[(rng.choice(["user", "assistant"]), rng.choice("abc")) for _ in range(rng.randint(1, 6))] for _ in range(30)]
    logged = {i: rng.choice(full)[:rng.randint(1, 6)] for i in range(120)}
    rows = [(i, n, *t) for i, turns in logged.items() for n, t in enumerate(turns)]
    rng.shuffle(rows)
    want = {}
    for i, turns in logged.items():
        if not any(len(o) > len(turns) and o[:len(turns)] == turns for o in logged.values()):
            want[min(k for k, o in logged.items() if o == turns)] = sum(o == turns for o in logged.values())
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.conv_id: r.n_copies for r in got.collect()} == want


def signatures(text: str) -> set:
    """The signatures by their definition, as tuples."""
    words = re.findall(r"[^\W_]+", text.lower())
    common = set(spotsigs.ANCHORS)
    out = set()
    for i, w in enumerate(words):
        if w in common:
            chain = [x for x in words[i + 1:] if x not in common][:spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                out.add((w, *chain))
        elif i >= spotsigs.BARE and not common & set(words[i - spotsigs.BARE:i]):
            chain = [x for x in words[i:] if x not in common][:spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                out.add(("", *chain))
    return out or ({tuple(words)} if words else set())


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def test_fingerprints_against_chains_of_words(spark, tmp_path):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    texts += ["", None, "the", "the cat", "one two three four five six seven eight nine ten eleven twelve", "The CAT sat on a mat, and the cat sat on a mat.", texts[0]]
    frame = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("lang", F.lit("x")).withColumn("source", F.lit(None).cast("string"))
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in spotsigs.op2_spotsigs(spark, str(tmp_path)).collect()}
    texts = [t or "" for t in texts]
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        edited = t[:len(t) - len(t) // 4] + after[:len(t) // 4]
        row = got[i * 3]
        assert row.n_chars == len(t) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.near_edited == pytest.approx(jaccard(signatures(t), signatures(edited)), abs=1e-3)
        assert row.near_next == pytest.approx(jaccard(signatures(t), signatures(after)), abs=1e-3)
        assert len([x for x in row.fingerprint.split(",") if x]) == len(signatures(t))
    assert got[0].fingerprint == got[(len(texts) - 1) * 3].fingerprint


def test_edges_of_fingerprints(spark):
    frame = spark.createDataFrame([(None, "the a b c"), (1, "x"), (1, "x"), (1, "y"), (2, None)], "doc_id long, text string")
    got = spotsigs.with_next(frame).collect()
    assert len(got) == 5 and sum(r.doc_id is None for r in got) == 1
    assert spotsigs.with_next(frame.limit(0)).count() == 0
    alone = spotsigs.with_next(spark.createDataFrame([(9, "abcdefgh")], "doc_id long, text string")).first()
    assert alone.next_head == "ab"


def test_near_classes_against_all_pairs(spark):
    rng = random.Random(2)
    base = [[rng.randrange(10**6) for _ in range(rng.randint(5, 40))] for _ in range(12)]
    sets = {}
    for i in range(90):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randrange(10**6))
        sets[i] = s
    sets[90], sets[91] = set(), sets[0]
    rows = [(i, sorted(s)) for i, s in sets.items()] + [(92, None)]
    members, pairs = spotsigs.near_classes(spark.createDataFrame(rows, "doc_id long, signatures array<int>"))
    of = {r.doc_id: r.class_id for r in members.collect()}
    assert of[90] is None and of[92] is None and of[91] == of[0]
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and of[a] == a and of[b] == b and jaccard(sets[a], sets[b]) >= 0.8}
    assert {(r.class_a, r.class_b) for r in pairs.collect()} == want


def test_near_documents_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "MEETING", 3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    shared = " ".join(f"the w{i} and" for i in range(60))
    rows += [(9_000 + i, f"{shared} of x{i} y{i} z{i}") for i in range(40)] + [(9_100, f"{shared} of x1 y1 z1"), (9_200, None), (None, shared)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("signatures", F.lit(1)).withColumn("class_id", F.lit("x"))
    got = {r.doc_id: (r.class_id, r.n_links) for r in spotsigs.near_documents(frame).collect()}
    sets = {d: frozenset(signatures(t or "")) for d, t in rows}
    named: dict = {}
    for d in sorted((d for d in sets if d is not None)):
        named.setdefault(sets[d], d)
    links = Counter()
    kinds = [k for k in named if k]
    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and jaccard(set(a), set(b)) >= 0.8:
                links[a] += 1
                links[b] += 1
    for d, k in sets.items():
        if d is None:
            assert got[d][0] == named.get(k)
        else:
            assert got[d] == ((named[k], links[k]) if k else (None, 0)), d
    assert got[9_000][1] >= 39


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1000, 4097])
def test_the_permutation_is_one(spark, n):
    want = [sharding.permute(x, n, 7) for x in range(n)]
    assert sorted(want) == list(range(n))
    got = spark.range(n).select("id", sharding.permuted(F.col("id"), n, 7).alias("p")).collect()
    assert all(want[r.id] == r.p for r in got)


def test_shards_are_even_and_gapless(spark):
    got = QUERIES["op8_feistel_shards"](spark, SMALL).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(got) == len(docs) and {r.doc_id for r in got} == set(docs)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        text = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "rows", None)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = sorted(got, key=lambda r: r.doc_id)
    assert all(r.position == sharding.permute(i, len(got), 20_240_501) for i, r in enumerate(order))


def test_edges_of_shards(spark):
    rows = spark.createDataFrame([(None, 1), (None, 1), (3, 2), (3, 2), (3, None)], "doc_id long, n int")
    got = sharding.shard_rows(rows, ["doc_id", "n"], 2).collect()
    odd = sharding.shard_rows(rows.select("*", F.lit("x").alias("part"), F.lit(1).alias("place"), F.lit(2).alias("slot"), F.lit(3).alias("a.b")), ["doc_id"], 2)
    assert odd.columns == ["doc_id", "n", "part", "place", "a.b", "row_number", "position", "shard", "slot"] and sorted(r.position for r in odd.collect()) == list(range(5))
    assert sorted(r.position for r in got) == list(range(5)) and sharding.shard_rows(rows.limit(0), ["doc_id"]).count() == 0


def targets(sizes: dict, epochs=1.5, repeats=2) -> dict:
    """Shares cut at the cap and shared anew until none is above, by the definition."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = epochs * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > repeats * sizes[s]}
        if not above:
            return out | {s: level * weight[s] for s in open_}
        for s in above:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
        open_ -= above
    return out


def test_mix_follows_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "d", None]), rng.choice([0, 1, 5, 40, 700])) for i in range(3000)] + [(None, "e", 5), (7, "a", 5), (7, "a", 5), (3001, "f", None)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("taken", F.lit("extra")).withColumn("rank", F.lit(1))
    documents, plan = mixing.mix(frame)
    got = documents.collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n or 0
    want = targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sum(r.to_word - r.from_word for r in plan.collect()) == sum(taken.values())
    again = mixing.mix(frame.repartition(7))[0].collect()
    assert all(r.rest.taken == "extra" for r in again)
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert mixing.mix(frame.limit(0))[0].count() == 0 and mixing.mix(frame.filter("size = 0"))[0].agg(F.sum("taken")).first()[0] == 0


def test_any_prefix_of_the_schedule_is_near_its_targets(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 3000), ("c", 500)], "source string, source_size long")
    want = mixing.source_targets(sizes)
    drawn = [r["rank"] for r in mixing.schedule(want, 6750.0, 5).orderBy("slot").collect()]
    share = {r["rank"]: r.target / 6750 for r in want.collect()}
    for n in (10, 100, 700, 1350):
        for k, part in share.items():
            assert abs(drawn[:n].count(k) - n * part) <= 5


def test_mixed_documents_stand_as_often_as_taken(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(20)), f"s{i % 3}", 9) for i in range(60)] + [(99, "", "s0", 0), (98, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    sized = docs.select("doc_id", "source", mixing.words_in(F.col("text")).alias("size"))
    taken = {r.doc_id: r.taken for r in mixing.mix(sized)[0].collect()}
    words = Counter()
    for r in mixing.mixed_documents(docs).collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert dict(words) == {k: v for k, v in taken.items() if v}


def test_mixed_rows_are_documents_of_their_own(spark):
    text = lambda k, n: "\n\t".join(f"{k}{i}" for i in range(n))
    rows = [(None, text("a", 10), "s", 1), (None, text("b", 2), "s", 1), (7, text("c", 2), "s", 1), (7, text("d", 10), "s", 2), (7, text("d", 10), "s", 2)]
    rows += [(i, text(f"x{i}_", 30), "t", 3) for i in range(40)] + [(50, " ", "s", 4), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `k1` int").withColumn("slot", F.lit("x")).withColumn("a.b", F.lit(2))
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    got = got.collect()
    whole = Counter(r[1] for r in rows)
    cut = [r for r in got if r.text not in whole]
    assert all(any(t and t.startswith(r.text) and t != r.text for t in whole) for r in cut) and len(cut) <= 2
    size = lambda rs: sum(len(r.text.split()) for r in rs)
    of = {s: sum(len((r[1] or "").split()) for r in rows if r[2] == s) for s in ("s", "t")}
    want = targets(of)
    assert all(abs(size([r for r in got if r.source == s]) - want[s]) <= 1 for s in want)
    # the small source is taken twice: each of its rows by its own size
    assert Counter(r.text for r in got if r.source == "s") == Counter({r[1]: 2 * whole[r[1]] for r in rows if r[2] == "s" and r[1].split()})
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    again = mixing.mixed_documents(docs.repartition(5)).collect()
    assert Counter(map(str, again)) == Counter(map(str, got))


def test_mixed_documents_stand_in_the_order_of_the_schedule(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(50)), f"s{i % 3}") for i in range(90)]
    got = mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    counts = Counter(r.source for r in got)
    for n in (20, 60, 100):  # any beginning holds the sources in their shares
        part = Counter(r.source for r in got[:n])
        assert all(abs(part[s] - n * counts[s] / len(got)) <= 5 for s in counts)


def test_words_are_counted_between_ascii_blanks(spark):
    texts = ["", None, " \n", "a", " a b\tc\x0bd\x0ce ", "a b", "\x1fa"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in frame.select(mixing.words_in(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
