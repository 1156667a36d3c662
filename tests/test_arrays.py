"""Array files that are split give the rows that a reader of whole files gives."""

from __future__ import annotations

import json
import random
from pathlib import Path

import pytest

from altcredit.operators.registry import FEEDS
from altcredit.plans import load
from altcredit.sources import arrays, feeds, paths
from altcredit.sources.store import TableStore
from tests import samples as s

SPEC = FEEDS["customers"]
NAMES = [f.raw for f in SPEC.fields]
ODD = [
    "plain", "[", "]", "{", "}", "[{", "}]", '"', '\\"', "\\", "\\\\", '\\\\"', "a\nb", "}\n{", ",", "},{", "é ñ 漢字 🎈", "\t", "", " ] } ",
    '"}', '{"x": [1, 2]}', "\\}", "x" * 300,
]


def _record(draw):
    row = {n: draw.choice(ODD) for n in NAMES if draw.random() < 0.9}
    if draw.random() < 0.3:
        row["more"] = draw.choice([[1, [2, "]"]], {"a": {"b": ["}", '"']}}, {}, [], None, 1.5, True])
    return row


def _parts(spark, size):
    """Splits of so many bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@pytest.fixture
def splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: _parts(spark, str(size))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _rows(frame):
    return [tuple(r) for r in frame.orderBy(*feeds.ORDER).select(*NAMES, "corrupt").collect()]


@pytest.mark.parametrize("size, indent", [(40, 2), (333, None), (100_000, 2)])
def test_split_files_give_the_rows_of_whole_ones(spark, folder, splits, size, indent):
    draw = random.Random(size)
    files = {f"{k}.json": [_record(draw) for _ in range(draw.choice([0, 1, 40]))] for k in range(4)}
    for name, rows in files.items():
        Path(folder, name).write_text(json.dumps(rows, ensure_ascii=draw.random() < 0.5, indent=indent), encoding="utf-8")
    want = _rows(feeds.read_whole_json(spark, folder, SPEC))
    splits(size)
    assert _rows(feeds.read_json(spark, folder, SPEC)) == want
    assert len(want) == sum(map(len, files.values()))


def test_a_large_file_uses_many_tasks(spark, folder, splits):
    rows = [s.customer(f"C{i}", business_name="[} \\ \"name\" " + "x" * (i % 50)) for i in range(3000)]
    path = s.write_feed(folder, "customers", rows)
    splits(50_000)
    found = feeds.read_json(spark, path, SPEC)
    places = found.groupBy("block_start").count().collect()
    assert len(places) == -(-Path(path).stat().st_size // 50_000) and min(r["count"] for r in places) > 5
    assert [r.customer_id for r in found.orderBy(*feeds.ORDER).collect()] == [r["customer_id"] for r in rows]


def test_a_record_over_many_splits(spark, folder, splits):
    rows = [s.customer("C1"), s.customer("C2", business_name="}" * 500 + "{" * 90), s.customer("C3", persona={"a": [{"b": "}"}] * 30})]
    path = s.write_feed(folder, "customers", rows)
    want = _rows(feeds.read_whole_json(spark, path, SPEC))
    for size in (7, 64, 200):
        splits(size)
        assert _rows(feeds.read_json(spark, path, SPEC)) == want


SOUND = ["[]", " [ ] \n", "", "  \n", "﻿[]", '{"customer_id": "C1"}', '{"customer_id": "C1"}\n', '﻿[ {"customer_id": "C1"} ]', "[{}]", '[{"pan": {}}]']
DAMAGED = [
    '[{"customer_id": "C1"}', '[{"customer_id": "C1"', '[{"customer_id": "C1}]', '{"customer_id": "C1"}]', '[{"customer_id": "C1"}}]',
    '"text"', "12", "x", '[{"a": 1}}, {"b": 2}', '[[{"customer_id": "C1"}]', "[{]}",
]
IN_PLACE = ['[{"customer_id": "C1"} {"customer_id": "C2"}]', '[{"customer_id": "C1"},, {"customer_id": "C2"}]', '[{"customer_id": tru}, {"customer_id": "C2"}]',
            '[{"customer_id": "C1"}, 5, {"customer_id": "C2"}]', '[{"customer_id": "C1"}, {"customer_id": "C2"},]']


@pytest.mark.parametrize("size", [5, 1000])
def test_sound_and_damaged_files(spark, folder, splits, size):
    for k, text in enumerate([*SOUND, *DAMAGED, *IN_PLACE]):
        Path(folder, f"{k:02d}.json").write_text(text, encoding="utf-8")
    splits(size)
    found: dict[int, list] = {}
    for r in feeds.read_json(spark, folder, SPEC).collect():
        found.setdefault(int(r.source_file[:2]), []).append((r.customer_id, r.corrupt))
    for k in range(len(SOUND)):
        assert not any(corrupt for _, corrupt in found.get(k, [])), SOUND[k]
    assert [len(found.get(k, [])) for k in range(len(SOUND))] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1]
    for k, text in enumerate(DAMAGED, len(SOUND)):
        assert found[k] == [(None, True)], text
    for k, text in enumerate(IN_PLACE, len(SOUND) + len(DAMAGED)):
        assert [c for _, c in found[k]].count(True) == 1 and ("C1", False) in found[k] or ("C2", False) in found[k], text


def test_one_damaged_record_fails_its_file_and_no_other(spark, folder, splits):
    splits(300)
    data = Path(folder, "data")
    data.mkdir()
    good, bad = [s.customer(f"C{i}") for i in range(5)], json.dumps([s.customer(f"D{i}") for i in range(5)])
    (data / "good.json").write_text(json.dumps(good))
    (data / "bad.json").write_text(bad.replace('"D3"', '"D3" oops'))
    store = TableStore(spark, f"{folder}/store")
    store.create_tables()
    result = load.load_feed(store, str(data), "customers", s.AS_OF, s.RUN_TS, "run")
    assert {(paths.name_of(r.source_path), r.attempted, r.loaded) for r in result.collect()} == {("good.json", 5, 5), ("bad.json", 0, 0)}
    assert sorted(r.customer_id for r in store.read("customers").collect()) == [f"C{i}" for i in range(5)]
    status = {paths.name_of(r.source_file): r.status for r in store.read("data_lineage").collect()}
    assert status == {"good.json": "SUCCESS", "bad.json": "FAILED"}


def test_state_of_splits_follows_from_both_cases():
    def row(start, flips, out, into, head=""):
        names = ("least", "tail", "depth")
        return {"source_path": "p", "source_file": "f", "block_start": start, "flips": flips, "head": head} | {
            f"{n}_{case}": x for case, values in (("out", out), ("in", into)) for n, x in zip(names, values)
        }

    # An open string at the end of the first split, closed in the second.
    rows = [row(0, True, (None, 2, 2), (None, 0, 0), "["), row(9, True, (None, 0, 0), (None, 0, -1)), row(20, False, (None, -1, -2), (None, 0, 0))]
    starts, damaged = arrays.starts_of(rows[::-1])
    assert not damaged and [starts["p", b] for b in (0, 9, 20)] == [
        arrays.Start(False, 0, 1, False), arrays.Start(True, 2, 1, False), arrays.Start(False, 1, 1, True),
    ]
    assert arrays.starts_of(rows[:2])[1] == [("p", "f")]


def test_positions_are_those_of_the_first_byte(spark, folder, splits):
    path = s.write_feed(folder, "customers", [s.customer(f"C{i}", persona="}" * 40) for i in range(60)])
    splits(500)
    rows = feeds.read_json(spark, path, SPEC).select("customer_id", *feeds.ORDER).collect()
    assert len({(r.block_start, r.ordinal) for r in rows}) == 60
    assert [r.customer_id for r in sorted(rows, key=lambda r: (r.block_start, r.ordinal))] == [f"C{i}" for i in range(60)]
