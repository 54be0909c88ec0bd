"""Tags met block by block: matches and offsets against one read at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenfold.operators import reads, tagindex

LOW, HIGH, OFFSET = 2, 7, 5


def drawn(seed, others):
    rng = np.random.default_rng(seed)
    text = lambda n, letters="ACGT": "".join(rng.choice(list(letters), int(n)))
    tags = [text(n) for n in rng.integers(10, 15, 60)] + [text(n) for n in (23, 24)]
    tags += [t[:k] for t in tags[:10] for k in (10, 11) if len(t) >= k] + [t[:4] + "N" + t[5:] for t in tags[10:16]] + tags[:8]
    tags += [t[:3] + ("A" if t[3] != "A" else "C") + t[4:] for t in tags[20:30]]
    if others:
        tags += [text(8), text(25), text(30), tags[3].lower(), text(12) + "é", text(11, "ACGTRY"), tags[4][:9] + "Y", None]
    tags = [(int(o), f"g{rng.integers(0, 60)}", t) for o, t in zip(rng.permutation(len(tags)), tags)]
    rows = []
    for i in range(500):
        tag = tags[rng.integers(0, len(tags))][2] or ""
        kind = rng.random()
        if kind < 0.5 and tag:
            p = int(rng.integers(0, len(tag)))
            tag = tag[:p] + str(rng.choice(list("ACGTNxé"))) + tag[p + 1 :]
        seq = text(rng.integers(LOW, HIGH + 2)) + tag + text(rng.integers(0, 12))
        rows.append(("l", i, ("AA" if kind < 0.9 else "CC") + seq[2:]))
    return tags, [*rows, ("l", 900, None), ("l", 901, ""), ("l", 902, "AA"), rows[0]]


def starts(rest, tag):
    return rest[:10] == tag[:10] and rest.startswith(tag)


def plainly(tags, seq, strict):
    if not seq or not seq.startswith("AA"):
        return None, "no_index"
    tags = [t for t in tags if t[2] is not None]
    longest = max(len(t[2]) for t in tags)
    at = seq[OFFSET : OFFSET + longest]
    exact = [(len(t), -o, g) for o, g, t in tags if starts(at, t)]
    if exact:
        return min(exact)[2], "exact"
    for off in range(LOW, HIGH + 1):
        rest = seq[off : off + longest]
        for n in sorted({len(t[2]) for t in tags}):
            near = []
            for o, g, t in tags:
                if len(t) == n and len(rest) >= n and (n >= 10 or rest == rest[:n]):
                    apart = [a for a, b in zip(rest, t) if a != b]
                    if (len(apart) == 1 and apart[0] in "GCATN") or (not apart and set(t) & set("GCATN")):
                        near.append((o, g))
            if near and not (strict and len({g for _, g in near}) > 1):
                return min(near)[1], "fuzzy"
    return None, "unmatched"


@pytest.mark.parametrize(("others", "strict"), [(False, False), (True, False), (True, True)])
def test_matches_of_blocks_equal_one_read_at_a_time(spark, monkeypatch, others, strict):
    monkeypatch.setattr(tagindex, "BLOCK", 40)
    if not others:  # no variant is written out
        monkeypatch.setattr(reads, "variants", None)
    tags, rows = drawn(7, others)
    sheet = spark.createDataFrame([("s", "l", "AA")], "sample_id string, lane string, index_seq string")
    decode = spark.createDataFrame(tags, "ord long, gene string, tag string")
    df = spark.createDataFrame(rows, "lane string, read_no long, seq string")
    got = reads.match_reads(df, sheet, [2], decode, OFFSET, strict=strict).collect()
    want = {i: plainly(tags, seq, strict) for _, i, seq in rows}
    assert {r["read_no"]: (r["gene"], r["kind"]) for r in got} == want and len(got) == len(want)
    assert {k for _, k in want.values()} == {"exact", "fuzzy", "unmatched", "no_index"}


@pytest.mark.parametrize("others", [False, True])
def test_offsets_of_blocks_equal_one_read_at_a_time(spark, monkeypatch, others):
    monkeypatch.setattr(tagindex, "BLOCK", 40)
    tags, rows = drawn(8, others)
    tags = [t for _, _, t in tags]
    longest = max(len(t) for t in tags if t)
    want = [sum(any(t is not None and starts(s[o : o + longest], t) for t in tags) for _, _, s in rows if s is not None) for o in range(21)]
    scan = reads.offset_scan(spark.createDataFrame(rows, "lane string, read_no long, seq string"), spark.createDataFrame([(t,) for t in tags], "tag string"), 20)
    assert {r["offset"]: r["hits"] for r in scan.collect()} == {o: n for o, n in enumerate(want) if n}
    if not others:  # no row a read and offset
        assert "Generate" not in scan._jdf.queryExecution().optimizedPlan().toString()


def test_no_tags_or_reads(spark):
    sheet = spark.createDataFrame([("s", "l", "AA")], "sample_id string, lane string, index_seq string")
    decode = spark.createDataFrame([(1, "g", "ACGTACGTAC")], "ord long, gene string, tag string")
    df = spark.createDataFrame([("l", 1, "AA" + "ACGTACGTAC")], "lane string, read_no long, seq string")
    none = decode.where(F.lit(False))
    assert [r["kind"] for r in reads.match_reads(df, sheet, [2], none, 2).collect()] == ["unmatched"]
    assert [r["kind"] for r in reads.match_reads(df, sheet, [2], decode, 2).collect()] == ["exact"]
    assert reads.match_reads(df.limit(0), sheet, [2], decode, 2).count() == 0
    assert reads.offset_scan(df, none).count() == 0 and reads.offset_scan(df.limit(0), decode).count() == 0
