import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidewater.llm import op13_turns as op

KIND = "conv_id long, turn long, role string, text string, depth string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_hand(rows):
    """The definition, node by node."""
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    nodes = {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            nodes.setdefault(v[:d], []).append(c)
    got = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        kids = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(len(q) > len(p) and q[: len(p)] == p for q in nodes)]
        saved = sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        last = ",".join(str(c) for c in sorted(members) if whole[c] == prefix)
        got.append((min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(last.encode()).hexdigest()))
    return told(got)


def told(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is not None, x) for x in r])


def made(n, seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c * rnd.choice([1, 1, 3]), rnd.choice([t, t, t, None]), rnd.choice(["user", "assistant", None, ""]), rnd.choice(["hi", "a b\tc", "", None, "x y z"]), "own"))
    return rows


@pytest.mark.parametrize("bits", [62, 2, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_definition(spark, seed, bits):
    rows = made(70, seed)
    rows += [(1000 + i, t, "user", x, "") for i in range(30) for t, x in enumerate(["same", "first turns", "and more of it"])]  # copies
    rows += [(2000, t, "user", f"turn {t % 3}", "") for t in range(300)]  # one long conversation, over several partitions
    rows += [(None, 1, "user", "nobody's", ""), (3003, 0, "user", "long " * 20_000, ""), (3003, 0, "user", "long " * 20_000, "")]
    got = op.trie(spark.createDataFrame(rows, KIND).repartition(3), bits)
    assert got.columns == COLUMNS
    assert told(got.collect()) == by_hand(rows)


def test_few_conversations(spark):
    for rows in ([], [(7, None, None, None, "")], [(20, 0, "user", "a", ""), (21, 0, "user", "a", "")]):
        assert told(op.trie(spark.createDataFrame(rows, KIND)).collect()) == by_hand(rows)


def test_ends_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(op, "_CHUNK", 7)
    members = spark.range(0, 10_000).select(F.col("id").alias("conv_id"), F.lit(1).cast("long").alias("depth"), (F.col("id") % 2).alias("fp"), F.lit(0).cast("long").alias("mark"), (F.col("id") % 3 > 0).alias("last"))
    want = {k: hashlib.sha256(",".join(str(i) for i in range(k, 10_000, 2) if i % 3).encode()).hexdigest() for k in (0, 1)}
    assert {r.fp: r.ends_sha256 for r in op.ends(members).collect()} == want
