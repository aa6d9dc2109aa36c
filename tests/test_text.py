"""Masking, key extraction, id and label normalising on hand-written rows, checked
against a plain-Python statement of the same rules."""

import re

from pyspark.sql import functions as F

from sessionlens.functions import extract_key, label_to_int, mask_line, normalize_id, tokens
from sessionlens.functions.text import HEX_PATTERN, IP_PATTERN, NUM_PATTERN

LINES = [
    "081109 203615 148 INFO dfs.DataNode$PacketResponder: Received block blk_-1608999687919862906 of size 91178",
    "Receiving block blk_38865049064139660 src: /10.250.19.102:54106 dest: /10.250.19.102:50010",
    "two ids blk_123 and blk_456 here",
    "no id at all 12345678 deadbeef 12",
    "\ttabs\tand nbsp  and   spaces ",
    "arabic digits ١٢٣ and 42",
    "ip 192.168.1.1:8080 and 1.2.3.4.5",
    "",
    "UPPER CASE BLK_77",
]


def py_mask(line: str) -> str:
    s = line.strip().lower()
    s = re.sub(IP_PATTERN, "<ip>", s)
    s = re.sub(HEX_PATTERN, "<hex>", s)
    s = re.sub(NUM_PATTERN, "<num>", s)
    return " ".join(s.split())


def test_mask_matches_python(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "value string")
    got = [r[0] for r in df.select(mask_line("value")).collect()]
    assert got == [py_mask(x) for x in LINES]


def test_key_from_raw_and_masked(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "value string")
    raw = [r[0] for r in df.select(extract_key(F.lower("value"))).collect()]
    masked = [r[0] for r in df.select(extract_key(mask_line("value"))).collect()]
    assert raw[0] == "blk_-1608999687919862906"
    assert masked[0] == ""          # masking first destroys negative ids (documented quirk)
    assert raw[1] == masked[1] == "blk_38865049064139660"
    assert raw[2] == "blk_123"      # first match wins
    assert raw[3] == ""
    assert raw[8] == "blk_77"


def test_normalize_id_and_labels(spark):
    df = spark.createDataFrame([(" Blk_1 ", " Anomaly"), ("blk_2", "normal "), ("blk_3", "1"), ("blk_4", "0"),
                                ("blk_5", "weird"), ("blk_6", None)], "b string, l string")
    rows = df.select(normalize_id("b").alias("b"), label_to_int("l").alias("l")).collect()
    assert [r.b for r in rows] == ["blk_1", "blk_2", "blk_3", "blk_4", "blk_5", "blk_6"]
    assert [r.l for r in rows] == [1, 0, 1, 0, 0, 0]


def test_tokens_unicode(spark):
    df = spark.createDataFrame([("Héllo wörld_1, a bç",), (None,)], "t string")
    rows = df.select(tokens("t").alias("k")).collect()
    assert rows[0].k == re.findall(r"(?u)\b\w+\b", "héllo wörld_1, a bç")
    assert rows[1].k == []


def test_parse_log_positions_and_timestamps(spark):
    from sessionlens.operators.parse import parse_log
    rows = [(0, "081109 203615 148 INFO Receiving block blk_-160 src"), (1, "no key here"),
            (2, "081109 203616 INFO blk_77 done"), (3, "garbage blk_5")]
    df = spark.createDataFrame(rows, "n long, value string")
    raw = {r.session_id: (r.pos, r.timestamp) for r in parse_log(df, "value", ["n"]).collect()}
    import datetime as dt
    assert raw == {"blk_-160": (0, dt.datetime(2008, 11, 9, 20, 36, 15)),
                   "blk_77": (2, dt.datetime(2008, 11, 9, 20, 36, 16)), "blk_5": (3, None)}
    masked = {r.session_id for r in parse_log(df, "value", ["n"], mask_first=True).collect()}
    assert masked == {"blk_77", "blk_5"}
