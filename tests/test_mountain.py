"""Mountain ranges against a plain Python version: growth in uneven cuts, proofs, forgeries."""

import hashlib

import pytest
from pyspark.sql import functions as F

from argosift.operators import mountain as M


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(contents):
    """(nodes, peaks lowest first, root) of one chain."""
    level = {(0, i): sha(f"leaf:{i + 1}:{c}") for i, c in enumerate(contents)}
    nodes, k = dict(level), 0
    while len(level) > 1:
        level = {(k + 1, i // 2): sha(f"node:{h}:{level[k, i + 1]}") for (_, i), h in level.items()
                 if i % 2 == 0 and (k, i + 1) in level}
        nodes |= level
        k += 1
    n = len(contents)
    peaks = [nodes[k, (n >> k) - 1] for k in range(n.bit_length()) if n >> k & 1]
    folded = peaks[0]
    for h in peaks[1:]:
        folded = sha(f"node:{h}:{folded}")
    return nodes, peaks, sha(f"root:{n}:{folded}")


def frame(spark, rows):
    return spark.createDataFrame(rows, "host_id string, sequence_number long, content_hash string")


def chains(lengths):
    return {h: [sha(f"{h}{i}") for i in range(n)] for h, n in lengths.items()}


@pytest.mark.parametrize("cuts", [[1.0], [0.3, 0.31, 1.0], [0.01, 0.5, 0.52, 0.9, 1.0]])
def test_heads_and_nodes_do_not_depend_on_cuts(spark, cuts):
    own = chains({"a": 1, "b": 700, "c": 1100, "d": 3})
    heads, nodes, done = None, [], dict.fromkeys(own, 0)
    for cut_at in cuts:
        part = []
        for h, c in own.items():
            to = max(done[h], round(len(c) * cut_at))
            part += [(h, i + 1, c[i]) for i in range(done[h], to)]
            done[h] = to
        new, after = M.advance(heads, frame(spark, part))
        nodes += [tuple(r) for r in new.collect()]
        rows = {r["host_id"]: r.asDict(True) for r in (heads.collect() if heads is not None else [])}
        rows |= {r["host_id"]: r.asDict(True) for r in after.collect()}
        heads = spark.createDataFrame(list(rows.values()), after.schema)
        assert {h: r["root"] for h, r in rows.items()} == {h: plain(c[:done[h]])[2] for h, c in own.items() if done[h]}
    want = {(h, k, i, x) for h, c in own.items() for (k, i), x in plain(c)[0].items()}
    assert len(nodes) == len(want) and set(nodes) == want


@pytest.fixture(scope="module")
def grown(spark):
    own = chains({"a": 1, "b": 700, "c": 600})
    rows = frame(spark, [(h, i + 1, x) for h, c in own.items() for i, x in enumerate(c)])
    nodes, heads = M.advance(None, rows)
    return own, rows.cache(), nodes.cache(), heads.cache()


def test_proofs_of_records(grown):
    own, rows, nodes, heads = grown
    some = rows.where("sequence_number in (1, 2, 512, 513, 600, 640, 700)")
    got = M.proved(M.proofs(some, nodes, heads), heads).collect()
    assert len(got) == 1 + 7 + 5 and all(r["proved"] for r in got)
    assert max(len(r["path"]) + len(r["peaks"]) for r in got) <= 15
    forged = some.withColumn("content_hash", F.sha2(F.lit("forged"), 256))
    assert not any(r["proved"] for r in M.proved(M.proofs(forged, nodes, heads), heads).collect())


def test_proof_of_another_number_or_beyond_the_end_fails(spark, grown):
    own, rows, nodes, heads = grown
    wrong = frame(spark, [("b", 5, own["b"][5]), ("b", 701, own["b"][0]), ("b", 0, own["b"][0]), ("x", 1, own["b"][0]),
                          ("b", None, own["b"][0]), ("b", 3, None)])
    got = M.proved(M.proofs(wrong, nodes, heads), heads)
    assert got.count() == 6 and got.where("proved").count() == 0


def test_growth_audit(spark, grown):
    own, rows, nodes, heads = grown
    first, rest = rows.where("sequence_number <= 300"), rows.where("sequence_number > 300")
    before = M.advance(None, first)[1]

    def verdicts(old, batch, after=heads):
        return {r["host_id"]: r["grown_valid"] for r in M.audit_growth(old, batch, after).collect()}

    assert verdicts(before, rest) == {"b": True, "c": True}
    assert verdicts(before, rest.where("host_id <> 'b' or sequence_number <> 400")) == {"b": False, "c": True}
    rewritten = M.advance(None, first.withColumn("content_hash", F.when(
        F.expr("host_id = 'c' and sequence_number = 7"), "x").otherwise(F.col("content_hash"))))[1]
    assert verdicts(rewritten, rest) == {"b": True, "c": False}
    assert verdicts(None, rows) == {"a": True, "b": True, "c": True}
    assert verdicts(before, rest, heads.withColumn("root", F.lit("x"))) == {"b": False, "c": False}


def test_audit_writes_peaks_only(spark, grown):
    own, rows, nodes, heads = grown
    before = M.advance(None, rows.where("sequence_number <= 512"))[1]
    rest = rows.where("sequence_number > 512")
    for old, batch in ((None, rows), (before, rest)):
        few, now = M.advance(old, batch, only_peaks=True)
        want = {r["host_id"]: (r["last_sequence"], r["peaks"], r["root"]) for r in M.advance(old, batch)[1].collect()}
        assert {r["host_id"]: (r["last_sequence"], r["peaks"], r["root"]) for r in now.collect()} == want
        assert few.count() <= 30


def test_empty_batch(spark, grown):
    nodes, heads = M.advance(grown[3], frame(spark, []))
    assert nodes.count() == 0 and heads.count() == 0
