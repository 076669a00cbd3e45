"""License scans, conversation repair and periodic runs against plain versions and their SQL."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from ledgerline.llm import licenses, periodic, queries, repair

DOCS = "doc_id bigint, text string, row string, words int, template string, label string, place int"
TURNS = "conv_id bigint, turn bigint, role string, text string, conv string, first int, fault string, a int"
LONG = " ".join(f"word{i}" for i in range(3_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, LONG), (5, LONG), (None, LONG), (None, None)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", 2) for i, t in rows], DOCS)


def by_sql(df, table, sql):
    con = duckdb.connect()
    con.register(table, df.toArrow())
    result = con.sql(sql).to_arrow_table()
    return Counter(tuple(str(r[c]) for c in sorted(r)) for r in result.to_pylist())


def rows_of(df):
    return Counter(tuple(str(r[c]) for c in sorted(r.asDict())) for r in df.collect())


@pytest.fixture
def tables(spark, tmp_path):
    """Writes a table where a query looks for it, and gives the folder."""

    def write(name, df):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def license_texts():
    rng = random.Random(5)
    rows, filler = list(ODD), ["mit", "license", "version", "the", "under", "cc", "by", "été", "x1"]
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            _, text = rng.choice([*licenses.PHRASES, *licenses.NOTICES])
            words = text.split()
            for _ in range(rng.choice([0, 0, 1, 3, 8])):  # change, leave out or put in
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = rng.choices(filler, k=rng.randrange(3))
                words = words or ["x"]
            parts += [" ".join(rng.choices(filler, k=rng.randrange(12))), " ".join(words).upper()]
        rows.append((10 + i, "\n".join(parts)))
    rows += [(200, "under the mit license " * 300), (201, "apache license version 2 apache license version 2")]
    return rows + [(300 + i, rows[12][1]) for i in range(40)]


def test_licenses_equal_their_sql(spark, tables):
    table = docs(spark, license_texts())
    found = queries.licensed(spark, tables("documents", table))
    assert rows_of(found) == by_sql(table, "documents", queries.license_sql())


def test_license_spans(spark):
    notice = dict(licenses.NOTICES)["gpl-3"]
    gpl = "This work is licensed under the GNU General Public License, version 3"
    rows = [
        (1, f"a b {gpl} c"),
        (2, gpl.replace("GNU", "well known GNU")),
        (3, gpl.replace("work is licensed", "x y z")),
        (4, "Apache License, Version 2.0, and MIT"),
        (5, "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
        (6, notice[:20]),
    ]
    found = {r.doc_id: r.spans for r in licenses.scan(docs(spark, rows)).collect()}
    assert [(s.label, s.first, s.last, s.covered) for s in found[1]] == [("gpl-3", 2, 13, 1.0)]
    assert [(s.label, s.first, s.last, s.matched) for s in found[2]] == [("gpl-3", 0, 13, 12)]
    assert found[3] == [] and found[6] == []
    assert [(s.label, s.base, s.first) for s in found[4]] == [("apache-2", True, 0)]
    assert [s.label for s in found[5]] == ["cc-by-nc"]
    with pytest.raises(ValueError):
        licenses.templates(spark, [("short", "two words")])
    assert licenses.scan(docs(spark, [])).collect() == []


def test_licenses_with_a_shuffled_join(spark, monkeypatch):
    table = docs(spark, license_texts()[:40])
    expected = rows_of(licenses.scan(table))
    monkeypatch.setattr(licenses, "BROADCAST_GRAMS", 0)
    assert rows_of(licenses.scan(table)) == expected


def plain_repair(rows):
    """The cheapest edits by all four states from the end on; rows (role, text, gone, truncated)."""
    after = {0: (0, "", ()), 3: (0, "", ())}

    def with_inserts(known):
        while True:
            before = dict(known)
            for state in range(4):
                then = 3 if state == 2 else 2
                if then in known:
                    cost, audit, lines = known[then]
                    line = "assistant:" if state == 2 else "user:"
                    known[state] = min(known.get(state, (10**9, "", ())), (cost + 3, "I" + audit, (line, *lines)))
            if known == before:
                return known

    after = with_inserts(after)
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    for role, text, gone, truncated in reversed(rows):
        now = {}
        for state in range(4):
            ways = [(after[state], 4, "D", ())] if state in after else []
            if not gone:
                more = 3 * truncated
                then = step.get((state, role[:1]))
                if then in after:
                    ways.append((after[then], more, "K", (f"{role}:{text}",)))
                for other in ("user", "assistant"):
                    then = step.get((state, other[0]))
                    if then in after:
                        ways.append((after[then], 3 + more, "R", (f"{other}:{text}",)))
            if ways:
                now[state] = min((k[0] + cost, edit + k[1], line + k[2]) for k, cost, edit, line in ways)
        after = with_inserts(now)
    cost, audit, lines = after[0]
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def turns(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice([f"Text {rng.randrange(30)}.", f"cut off {rng.randrange(30)}", "End!\n ", " \t", "", None])
            rows.append((conv, rng.choice([turn, turn, 2 * turn, None, 1]), role, text))
    return rows + [(None, 1, "user", "Hm?"), (None, 2, "assistant", "Yes."), (900, None, None, None)] + rows[:9]


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], TURNS)


def test_repair_equals_the_plain_version(spark):
    rows = turns(1, 60, 14)
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    expected = {}
    for conv, group in by_conv.items():
        group = [(t, " " if r is None else r, " " if x is None else x) for _, t, r, x in group]
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, given, counts, illegal = set(), [], Counter(), 0
        for n, (_, role, text) in enumerate(group):
            blank = not text.strip(repair.BLANKS)
            again = not blank and (role, text) in seen
            cut = not blank and not again and text.rstrip(repair.BLANKS)[-1] not in ".!?"
            seen.add((role, text))
            counts.update(blank=blank, again=again, cut=cut)
            given.append((role, text, blank or again, cut))
            illegal += n > 0 and group[n - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        times = [t for t, _, _ in group if t is not None]
        gaps = max(times) - min(times) + 1 - len(set(times)) if times else 0
        expected[conv] = (gaps, counts["blank"], counts["again"], counts["cut"], illegal, *plain_repair(given))
    found = {r.conv_id: tuple(r)[1:] for r in repair.repair(table_of(spark, rows)).collect()}
    assert found == expected
    assert repair.repair(table_of(spark, [])).collect() == []


def test_repair_query_equals_its_sql(spark, tables):
    table = table_of(spark, turns(2, 80, 12))
    found = queries.repaired(spark, tables("conversations", table))
    assert rows_of(found) == by_sql(table, "conversations", queries.oracle_sql()["op12_streamed_repair"])


def test_repair_of_a_giant_conversation(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(repair, "BLOCK_ROWS", 1000)
    monkeypatch.setattr(repair, "SPILL_BYTES", 100)
    given = [(rng.choice(["user", "assistant", "system"]), f"t{i}", rng.random() < 0.1, rng.random() < 0.2) for i in range(30_000)]
    now = repair.Conversation(repair.Program())
    for turn, (role, text, gone, cut) in enumerate(given):
        now.add(turn, role, text, "sua".find(role[0]), 1 if gone else 3 * cut)
    assert len(now.pointers.sizes) == 30 and now.pointers.packed._rolled
    told = now.result()
    cost, audit = told[5], told[6]
    assert len(audit.replace("I", "")) == len(given)
    again = 0
    edits = iter(audit)
    out = []
    for role, text, gone, cut in given:
        for edit in edits:
            if edit == "I":
                again += 3
                out.append("assistant:" if out and out[-1].startswith("user") else "user:")
                continue
            if edit == "D":
                again += 4
            else:
                assert not gone
                again += 3 * (edit == "R") + 3 * cut
                name = role if edit == "K" else ("assistant" if out and out[-1].startswith("user") else "user")
                out.append(f"{name}:{text}")
            break
    for _ in edits:
        again += 3
        out.append("assistant:" if out and out[-1].startswith("user") else "user:")
    assert again == cost
    assert hashlib.sha256("\n".join(out).encode()).hexdigest() == told[7]
    initials = "".join(x[0] for x in out).lstrip("s")
    assert set(initials[::2]) <= {"u"} and set(initials[1::2]) <= {"a"} and len(initials) % 2 == 0
    assert cost <= plain_bound(given)


def plain_bound(rows):
    """The cost of one way that is always open: each row kept or reroled in turn, or deleted."""
    cost, user = 0, True
    for role, _, gone, cut in rows:
        if gone:
            cost += 4
            continue
        cost += 3 * cut + 3 * (role != ("user" if user else "assistant"))
        user = not user
    return cost + 3 * (not user)


def test_repair_over_many_batches(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"Row {i % 5000}.") for i in range(30_000)]
    option = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(option)
    spark.conf.set(option, "700")
    try:
        (row,) = repair.repair(table_of(spark, rows)).collect()
    finally:
        spark.conf.set(option, before)
    assert row.duplicate == 25_000 and row.audit == "K" * 5000 + "D" * 25_000 and row.cost == 100_000
    lines = "\n".join(f"{r}:{t}" for _, _, r, t in rows[:5000])
    assert row.repaired_sha256 == hashlib.sha256(lines.encode()).hexdigest()


def plain_runs(words, least=periodic.LEAST, exponent=periodic.EXPONENT):
    out = []
    for p in range(1, len(words) // exponent + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            size = j + p - i
            if size >= max(least, exponent * p):
                part = words[i : i + size]
                if not any(part[q:] == part[:-q] for q in range(1, p)):
                    out.append((i, size, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def symbols(rng):
    alphabet = rng.choice([1, 2, 3, 5])
    out = []
    for _ in range(rng.randrange(5)):
        unit = [rng.randrange(alphabet) for _ in range(rng.randrange(1, 6))]
        out += (unit * 20)[: rng.randrange(30)] + [rng.randrange(alphabet) for _ in range(rng.randrange(6))]
    return out


def test_lyndon_words_and_runs():
    rng = random.Random(7)
    for _ in range(400):
        x = symbols(rng)
        short = x[:20]
        longest = [
            max(j - i for j in range(i + 1, len(short) + 1) if all(short[i:j] < short[k:j] for k in range(i + 1, j)))
            for i in range(len(short))
        ]
        assert periodic.lyndon(np.array(short, np.int64)).tolist() == longest
        assert periodic.runs(np.array(x, np.int64)) == plain_runs(x)


def test_runs_equal_the_plain_version(spark, tables):
    rng = random.Random(8)
    rows = [*ODD, (7, "a b a b"), (8, "x " * 500), (9, "a b\n" * 7), (10, ("p q r " * 9 + LONG[:3000] + " ") * 5)]
    rows += [(20 + i, " ".join(f"w{s}" for s in symbols(rng))) for i in range(300)]
    expected = Counter()
    for i, text in rows:
        words = queries.planted(i, (text or "").encode().split())
        found = plain_runs(words)
        keep = [True] * len(words)
        for start, size, p in found:
            keep[start + p : start + size] = [False] * (size - p)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        told = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        left = b" ".join(w for w, k in zip(words, keep) if k)
        expected[
            (i, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
             hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(left).hexdigest())
        ] += 1
    folder = tables("documents", docs(spark, rows))
    assert Counter(tuple(r) for r in queries.periodic_runs(spark, folder).collect()) == expected
    assert periodic.find_runs(docs(spark, [])).collect() == []
    plain = {r.doc_id: r for r in periodic.find_runs(docs(spark, rows)).collect() if r.doc_id is not None}
    assert [tuple(r) for r in plain[8].runs] == [(0, 500, 1)] and plain[8].collapsed == "x"


def test_planted_words():
    words = [str(i).encode() for i in range(50)]
    for i in range(200):
        lot = queries.zlib.crc32(str(i).encode())
        g = lot // 10
        a, expected = g % 50, words
        if lot % 10 == 0:
            p = 1 + (50 - a) // (3 + g % 8)
            expected = [words[k] if k < a else words[a + (k - a) % p] for k in range(50)]
        assert queries.planted(i, words) == expected
    assert queries.planted(None, words) == words and queries.planted(5, []) == []
