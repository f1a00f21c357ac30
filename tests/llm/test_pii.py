"""Pattern spans against Python's re, and disclosing terms on a small corpus."""

import hashlib
import math
import random
import re

from ledgerspark.llm import pii, queries

SCHEMA = "doc_id long, text string, digest string, spans int"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, (name, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if valid(name, m[0])]


def check(spark, rows):
    got = pii.find(spark.createDataFrame(rows, SCHEMA)).collect()
    found = sorted(((r.doc_id, [tuple(s)[:3] for s in r.spans if s["rank"] < 4]) for r in got), key=str)
    assert found == sorted(((r[0], plain(r[1])) for r in rows), key=str)


def test_patterns_match_pythons(spark):
    rng = random.Random(11)
    cards = ["4111 1111 1111 1111", "4111111111111112", "5500-0000-0000-0004", "1 2 3", "00000000000000000000"]
    bits = [*cards, "a.b+c@d-e.f.g", "x@y@z.co", "a@b.c+d@e.f", "@", ".", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.0255", "+1 (555) 010-9999", "+44 20", "+1+2 345 678 9012", "é", "😀", " ", "-", "0", "9", "\n", "mail", "+", "%", "4111 1111 1111 1111 0"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 30))), "z", 1) for i in range(400)]
    rows += [(None, None, "z", 1), (901, "", "z", 1), (902, rows[0][1], "", 0), (902, rows[0][1], "", 0)]
    check(spark, rows)


def test_long_runs(spark):
    def rows(n):
        return [(1, "a" * 4 * n, "", 0), (2, "7" * 4 * n + "x", "", 0), (3, "a.b-" * n + "@x.yz", "", 0), (4, "1 " * n, "", 0), (5, "1.2.3.4 " * n, "", 0), (6, "+1" * n, "", 0), (7, "a@b." * n, "", 0)]

    check(spark, rows(500))
    assert pii.find(spark.createDataFrame(rows(40_000), SCHEMA)).count() == 7


def test_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check(spark, [(r.doc_id, r.text, "", 0) for r in docs])


def corpus():
    rows = [(i, f"plain prose number {chr(97 + i % 26)} about nothing much, a story for once", "", 0) for i in range(60)]
    rows += [(100 + i, f"{'abc'[i % 3]} story. Contact Zorblax today via zor@blax.org for {'xyz'[i % 3]} prose.", "", 0) for i in range(6)]
    rows += [(200 + i, f"the prose went on via today contact {i}", "", 0) for i in range(20)]
    rows.append((300, "A sighting of ZORBLAX! Nothing else.", "", 0))
    return rows


def test_terms_that_disclose(spark):
    rows = corpus()
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    text = dict((r[0], r[1]) for r in rows)
    terms = {d: [text[d][s["start"] : s["end"]].lower() for s in spans if s["rank"] == 4] for d, spans in got.items()}
    # seen with the address only: in 3 distinct texts near it and in one more; 'contact' and 'today' occur elsewhere too often
    share = {"zorblax": 3 / 4}
    assert all(not t for d, t in terms.items())  # 3 of 4 is below the threshold
    low = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, SCHEMA), share=0.7, bits=3.0).collect()}
    terms = {d: [text[d][s["start"] : s["end"]].lower() for s in spans if s["rank"] == 4] for d, spans in low.items()}
    assert share["zorblax"] >= 0.7 and terms[300] == ["zorblax"] and all("zorblax" in terms[100 + i] for i in range(6))
    assert all(not terms[200 + i] and not terms[i] for i in range(20))
    cleaned = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, SCHEMA), share=0.7, bits=3.0).collect()}
    assert cleaned[300] == "A sighting of [TERM]! Nothing else." and "[EMAIL]" in cleaned[100] and "blax" not in cleaned[100].lower()
    assert cleaned[5] == text[5] and len(cleaned) == len(rows)


OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z0-9+/_-]{16,}={0,2}|[0-9]{9,})(?![A-Za-z0-9+/_=@-])")
GIVEN = r"[^\W][\"'\]]? {0,3}(?:=>?|:=?) {0,3}[\"'(\[]{0,2}"


def plain_shapes(rows, share=pii.SHARE, part=pii.PART):
    """Spans of disclosing shapes by text, from counts over all distinct texts."""
    texts = {r[1] or "" for r in rows}
    seen, classes = {}, {"given": sum(len(re.findall(GIVEN + r"\S", t)) for t in texts)}
    words = sum(t.count(" ") + 1 for t in texts if t)
    tokens = {t: [] for t in texts}
    for t in texts:
        base = plain(t)
        for k, _, _ in base:
            classes[k] = classes.get(k, 0) + 1
        for m in OPAQUE.finditer(t):
            if not re.search("[0-9]", m[0]):
                continue
            kind = "digits" if m[0].isdigit() else "hex" if re.fullmatch("[0-9a-f-]+|[0-9A-F-]+", m[0]) else "key"
            over = [k for k, a, b in base if a < m.end() and b > m.start()]
            own = over[0] if over else "given" if re.search(GIVEN + "$", t[: m.start()]) else None
            tokens[t].append((f"{kind}:{len(m[0])}", m.start(), m.end(), bool(over)))
            seen.setdefault(f"{kind}:{len(m[0])}", []).append((own, t))
    told = set()
    for shape, found in seen.items():
        n = len({t for _, t in found})
        for c in {c for c, _ in found if c is not None}:
            both = len({t for k, t in found if k == c})
            own = math.log2(words / classes[c])
            if both >= pii.SUPPORT and both / n >= share and math.log2(both / n) + own >= part * own:
                told.add(shape)
    return {t: [(a, b) for s, a, b, base in found if s in told and not base] for t, found in tokens.items()}


def shaped():
    rng = random.Random(9)
    mixed = lambda n, of="0123456789abcdef": "".join(rng.choice(of) for _ in range(n))
    rows = [(i, f"clean prose, number {i}: none", "", 0) for i in range(40)]
    rows += [(100 + i, f"some config {'key' if i % 2 else 'Token'} = \"{mixed(32)}\" and on", "", 0) for i in range(6)]
    rows += [(120 + i, f"a hash {mixed(32)} with no name", "", 0) for i in range(1)]  # the same shape, elsewhere
    rows += [(130 + i, f"commit {mixed(24)} pushed; id: {mixed(20)}A" if i < 2 else f"commit {mixed(24)} pushed", "", 0) for i in range(8)]  # mostly not given
    rows += [(150 + i, f"secret: {mixed(20, 'abcXYZ789')}7z== next", "", 0) for i in range(4)] + [(160, f"loose {mixed(20, 'abcXYZ789')}7z==", "", 0)]
    rows += [(170 + i, f"card 411111111111111{i} there", "", 0) for i in range(5)] + [(180, None, "", 0), (181, "", "", 0)]
    return rows


def check_shapes(spark, rows):
    found = {}
    for r in pii.find(spark.createDataFrame(rows, SCHEMA)).collect():
        found[r.doc_id] = [(s["start"], s["end"]) for s in r.spans if s["rank"] == 4 and s["label"] != "TERM"]
    want = plain_shapes(rows)
    assert found == {r[0]: want[r[1] or ""] for r in rows}
    return found


def test_shapes_that_disclose(spark):
    rows = shaped()
    found = check_shapes(spark, rows)
    assert all(found[100 + i] for i in range(6)) and found[120] and all(found[150 + i] for i in range(4)) and found[160]
    assert not any(found[i] for i in range(40)) and not any(found[132 + i] for i in range(6))
    cleaned = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert cleaned[101] == 'some config key = "[HEX]" and on' and cleaned[160] == "loose [KEY]" and cleaned[3] == rows[3][1]


def test_shapes_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    found = check_shapes(spark, [(r.doc_id, r.text, "", 0) for r in docs])
    assert any(found.values())


def test_sanitise_keeps_columns_of_any_name(spark):
    rows = [(1, "mail a@b.cd", 1, 2, 3), (None, None, 4, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own_digest int, digest int, spans int")
    got = pii.sanitise(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted([(1, "mail [EMAIL]", 1, 2, 3), rows[1]], key=str)


def test_empty(spark):
    assert pii.find(spark.createDataFrame([], SCHEMA)).count() == 0


def test_counts_of_the_query(spark):
    """Each kind is counted by its own spans, wherever these stand in the array of all."""
    d = "/root/testdata/sf0.001"
    columns = [f"n_{k}" for k in pii.KINDS]
    got = {r.doc_id: (*(r[c] for c in columns), r.base_sha256) for r in queries.op8_pii(spark, d).collect()}
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
        spans = plain(r.text)
        digest = hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        want[r.doc_id] = (*(sum(s[0] == k for s in spans) for k in range(4)), digest)
    assert got == want and sum(w[1] + w[2] + w[3] for w in want.values())
