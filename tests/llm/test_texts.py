"""Leakage, splitting, packing, reading level, credentials and provenance on small inputs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import credentials, leakage, packing, provenance, readability, splitting

ITEM = (
    "In the storage test the worker 12 reads 40 pages from the disk 7 before it sends 3 signals to the node 9 and waits 25 seconds for the "
    "answer of the queue 4 that holds 60 tickets and 2 locks while Ann gives 5 keys to Bob who keeps 11 of them"
)
INTRO = "Read the text below with care and then choose the best answer. "


def held(text: str, item: str = ITEM) -> float:
    found = leakage.match(leakage.Items([(1, item)], [0]), text)
    return found[0][1] if found else 0.0


def test_passages_are_recognised():
    assert held(ITEM) == 1 and held(ITEM.upper()) == 1 and held("x " * 500 + ITEM + " y" * 500) == 1
    assert held(re.sub(r"\d+", lambda m: str(int(m.group()) * 7 + 1), ITEM)) >= 0.4  # every number changed
    assert held(ITEM.replace("Ann", "Eve").replace("Bob", "Tom")) >= 0.9
    assert held(" ".join(w if i % 4 else "zzz" for i, w in enumerate(ITEM.split()))) >= 0.4
    assert held(ITEM[: len(ITEM) // 2]) >= 0.4
    assert held("the worker reads pages from the disk. He waits for the answer. Keys of them to the node") == 0
    assert held("") == 0 and held("a") == 0


def test_slots_must_be_replaced_consistently():
    item = "set 1 to 2 then 1 to 3 then 2 to 3 then 3 to 1 then 2 to 1 then 1 to 2"
    swap = {"1": "7", "2": "8", "3": "9"}
    same = re.sub(r"\d", lambda m: swap[m.group()], item)
    rng = random.Random(2)
    mixed = re.sub(r"\d", lambda m: str(rng.randint(10, 99)), item)
    names = leakage.replacements(item.split(), set(), same.split(), [(i, i) for i in range(len(item.split()) - 2)])
    assert names[0] == {"7": "1", "8": "2", "9": "3"} and names[1] == names[2]
    other = leakage.replacements(item.split(), set(), mixed.split(), [(i, i) for i in range(len(item.split()) - 2)])
    assert other[1] < leakage.CONSISTENT * other[2]


def test_both_ways_of_joining_give_the_same(spark):
    rng = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    items = [(i, INTRO + " ".join(rng.choice(words) for _ in range(40))) for i in range(12)]
    docs = [(d, " ".join(rng.choice(words) for _ in range(80)) + " " + (items[d % 12][1][len(INTRO):] if d % 3 == 0 else "") + (INTRO if d % 5 == 0 else "")) for d in range(40)]
    d = spark.createDataFrame([*docs, (99, None), (98, ""), (None, ITEM)], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    t = spark.createDataFrame([*items, items[0], (77, None), (None, "x"), (78, "")], "item_id long, text string")
    rows = lambda **k: {tuple(r) for r in leakage.leaks(d, t, **k).collect()}
    assert rows() == rows(broadcast_bytes=0) and {(r[0], r[1]) for r in rows()} == {(x, x % 12) for x in range(0, 40, 3)}
    assert leakage.leaks(d.limit(0), t).count() == 0 and leakage.leaks(d, t.limit(0)).count() == 0


def test_splitting_is_an_exact_round_trip(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice(["word ", "é", "漢字", "\n", "x = 1;\n\n", "🙂", "}\n", "a" * 40]) for _ in range(n))
    rows = [(i, text(rng.randint(1, 400)), rng.choice([16, 64, 300]), rng.choice([0, 5, 8])) for i in range(60)] + [(90, None, 64, 0), (91, "", 64, 0), (92, "x" * 100, None, 0), (93, "y" * 100, 64, None), (94, text(30_000), 1000, 700)]
    df = spark.createDataFrame(rows, "id int, t string, lim int, over int").withColumn("text", F.lit("clash"))
    pieces: dict[int, list] = {}
    for r in splitting.split(df, "t", "lim", "over", ["id"]).collect():
        pieces.setdefault(r["id"], []).append(r)
    for i, t, limit, over in rows:
        if not t or limit is None or len(t.encode()) <= limit:
            assert i not in pieces
            continue
        got = sorted(pieces[i], key=lambda r: r["piece"])
        whole = b""
        for n, r in enumerate(got):
            raw = r["text"].encode()
            assert len(raw) <= limit and r["piece"] == n + 1 and (n == 0 or r["repeated"] >= min(over or 0, len(whole)))
            assert whole.endswith(raw[: r["repeated"]]) and r["start_byte"] == len(whole) - r["repeated"]
            whole += raw[r["repeated"] :]
        assert whole == t.encode()
    with pytest.raises(Exception, match="no room"):
        splitting.split(df.where("id = 94").withColumn("over", F.lit(999)), "t", "lim", "over", ["id"]).collect()


def test_limits_in_any_spelling(spark):
    limits = spark.createDataFrame([("source_piece", "C++", 10, 2), ("source_piece", None, 20, 2), ("other", None, 1, 0)], "purpose string, lang string, max_size long, overlap_size long")
    nodes = spark.createDataFrame([("a", "cpp"), ("b", "python"), ("c", None)], "node_id string, lang string")
    assert {r["node_id"]: r["max_size"] for r in splitting.with_limits(nodes, limits).collect()} == {"a": 10, "b": 20, "c": 20}
    assert splitting.with_limits(nodes, limits.limit(0)).where("max_size is not null").count() == 0


def test_packing_keeps_everything(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(f"word{rng.randint(0, 99)}" for _ in range(rng.choice([1, 5, 40, 300, 1500])))) for i in range(120)] + [(None, "null key")] * 60 + [(500, None), (501, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sizes = {r["doc_id"]: r["tokens"] for r in packing.measure(df.where("doc_id is not null"), "doc_id", "text").collect()}
    packed = packing.pack(df, "doc_id", "text", 512, shard_items=40).collect()
    room: dict[int, int] = {}
    for r in packed:
        room[r["container"]] = room.get(r["container"], 0) + r["tokens"]
    assert max(room.values()) <= 512
    for key, size in sizes.items():
        parts = sorted((r["first_token"], r["tokens"]) for r in packed if r["doc_id"] == key)
        assert sum(n for _, n in parts) == size and len(parts) == max(1, -(-size // 512))
    assert sum(r["doc_id"] is None for r in packed) == 60 and packing.pack(df.limit(0), "doc_id", "text", 512).count() == 0


EASY = "The dog ran to the house. It was a hot day and he had no water. We gave him some and he was glad. "
HARD = "Notwithstanding considerable methodological heterogeneity, subsequent investigations demonstrated that institutional configurations systematically constrain organisational adaptation within the region. "
POLISH = "Każdy dokument powinien zostać sprawdzony przed publikacją, ponieważ system nie potrafi samodzielnie wykryć błędów. "


def test_reading_levels(spark):
    docs = [(i, "a" if i % 2 else "b", (EASY if i < 20 else HARD) * 12) for i in range(40)] + [(90, "a", POLISH * 20), (91, "a", None), (92, "a", ""), (93, "b", HARD * 12), (94, None, EASY * 12)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("band", F.lit("clash")).withColumn("lang", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(i, "r", 1 if i < 20 else 4) for i in range(40)] + [(1, "s", None), (2, "s", 9), (777, "s", 2)], "doc_id long, rater string, band int")
    found = {r["doc_id"]: r["band"] for r in readability.bands(df, labels).collect()}
    assert found[93] == 4 and found[94] == 1 and not {90, 91, 92} & set(found)
    assert readability.agreement(df, labels).first()["agreement"] > 0.9
    assert readability.bands(df, labels.limit(0)).count() == 0 and readability.bands(df.limit(0), labels).count() == 0
    assert readability.bands(df, labels.where("doc_id < 4")).count() > 0
    assert readability.english_prose(POLISH * 20)[1] == 0


def test_credentials():
    at = lambda line: [line[a:b] for a, b, _ in credentials.scan_line(line)]
    assert at('password = "exAmple-q7Zp2LkV!9"') == ["exAmple-q7Zp2LkV!9"]
    assert at('config["upstream"] = "q7Zp2LkVx81hYt5RwN3mBd6Q"') == ["q7Zp2LkVx81hYt5RwN3mBd6Q"]
    assert not at('password = "EXAMPLE"') and not at('password = "00000000"') and not at("password = get_password()")
    assert credentials.alphabet_of("ABCDEFGH234567AB") == 32 and credentials.alphabet_of("abc123") == 36 and credentials.alphabet_of("aB1") == 64


def test_series_with_long_numbers():
    lines = [f"value_{i} = {10 ** 20 + i}" for i in range(20)]
    share, longest = provenance.mechanical_share(lines)
    assert share == 1 and longest == 20
    assert provenance.mechanical_share(["x = " + "1" * 5000] * 8)[1] == 0


def test_vectors_of_grades_are_stable():
    x = np.random.default_rng(1).normal(size=(60, len(readability.FEATURES)))
    y = (x[:, 0] > 0) * 2.0 + 1
    a, b = (readability.train(x, y, ["s", "t"] * 30, np.ones(60)).grade(x) for _ in range(2))
    assert (a == b).all()
