"""One JSON object a file, read in splits: against Python's own parser."""

import json
import os
import random

import pytest

from quire.sources import json_objects as J
from quire.sources.patients import read_patients

BITS = ["a", "}", "{", "}}}", '"', "\\", "\\\"", ",", ":", "\n", "é", " ", "[", "word " * 20, "{\"k\": \"v\"}"]


def patients(rng, n):
    out = {}
    for i in range(n):
        fields = {f: "".join(rng.choice(BITS) for _ in range(rng.randrange(6))) for f in ("arrival", "triage", "codes") if rng.random() < 0.8}
        if rng.random() < 0.2:
            fields["vitals"] = None
        out[f"p{i}" + rng.choice(["", "}", '"x', "\\", "{"])] = None if rng.random() < 0.05 else fields
    return out


def test_objects_at_any_split_size(spark, tmpdir_path):
    rng = random.Random(4)
    files = {"one_line.json": json.dumps(patients(rng, 300)), "pretty.json": json.dumps(patients(rng, 120), indent=2) + "\n",
             "raw.json": "﻿" + json.dumps(patients(rng, 60), ensure_ascii=False), "empty.json": "{}", "blank.json": " { \n } \n",
             "null_last.json": '{"a": {"arrival": "x"}, "b": null}',
             "giant.json": json.dumps({"g": {"arrival": "}" * 4000 + '"' * 50}, "h": {"arrival": "{"}})}
    for name, text in files.items():
        with open(os.path.join(tmpdir_path, name), "w", encoding="utf-8") as f:
            f.write(text)
    expected = [(k, *((v or {}).get(f) for f in ("arrival", "triage", "codes", "vitals")))
                      for text in files.values() for k, v in json.loads(text.removeprefix("﻿")).items()]
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(n) for n in names]
    try:
        for size in (1 << 20, 700, 150):
            spark.conf.set(names[0], size)
            spark.conf.set(names[1], 1)
            got = read_patients(spark, tmpdir_path, layout="object").select("patient_id", "arrival", "triage", "codes", "vitals").collect()
            assert sorted(map(tuple, got), key=str) == sorted(expected, key=str), size
            if size == 150:
                assert J._chunks(spark, os.path.join(tmpdir_path, "one_line.json")).select("block").distinct().count() > 50
    finally:
        for n, v in zip(names, old):
            spark.conf.set(n, v)


def test_a_malformed_entry_fails(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "x.json"), "w") as f:
        f.write('{"a": {"arrival": "x"}, "b": {"arrival": oops}}')
    with pytest.raises(Exception, match="malformed patient entry"):
        read_patients(spark, tmpdir_path, layout="object").collect()
