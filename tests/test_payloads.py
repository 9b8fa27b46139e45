"""Whole numbers of event payloads."""

from __future__ import annotations

from tactigrid.sources import readers

FIELDS = "Team Player Event Outcome Mins Secs X Y X2 Y2 half source confidence track_id frame".split()


def test_long_frames_keep_their_digits(spark):
    texts = {"9007199254740993": 9007199254740993, " 60000000000000061 ": 60000000000000061, "-9007199254740993": -9007199254740993, "2.5e1": 25, "7.9": 7, "0": None, "12d": None, "nan": None, "inf": None, "": None, "99999999999999999999": None, None: None}
    raw = spark.createDataFrame([tuple(t if f in ("frame", "Mins") else None for f in FIELDS) for t in texts], ", ".join(f"{f} string" for f in FIELDS))
    rows = readers.payload_rows(raw).select("frame", "mins").collect()
    assert [r.frame for r in rows] == list(texts.values())
    assert [r.mins for r in rows] == [0, 0, 0, 25, 7, 0, 0, 0, 0, 0, 0, 0]
