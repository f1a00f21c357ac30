"""Line templates against plain Python."""

import math
import re

from ledgerspark.llm import lines

SCHEMA = "doc_id long, text string, n_chars long, h string, id int"


SPACES = str.maketrans("\t\r\f\x0b", "    ")


def passages(line):
    """The passages of a line, each with the white space after it."""
    out, at = [], 0
    for m in re.finditer(r"[.!?][\"')]{0,2}[ \t]+", line):
        stop = m.start()
        if not re.search(r"[.!?]", line[max(stop - lines.STRETCH, 0) : stop]) and stop >= lines.STRETCH and len(m[0].lstrip(".!?\"')")) <= 4:
            out.append(line[at : m.end()])
            at = m.end()
    return [*out, line[at:]]


def plain(rows):
    """What stays of each row's text: templates as tuples, documents by id and text, nulls last."""

    def general(line):  # with the blanks as they are
        return ["<*>" if any(c in "0123456789" for c in w) else w for w in line.translate(SPACES).split(" ")]

    def words(line):
        return [w for w in general(line) if w]

    def keys(line):
        own = words(line)
        n = len(own)
        if n < lines.LEAST:
            return []
        out = [(0, " ".join(general(line)).strip(" "), n < lines.LONG)] if n < lines.LONG or len(passages(line)) == 1 else []
        if n >= lines.LONG:
            width = math.ceil((n - lines.LEAD) / lines.THIRDS)
            for k in range(1, lines.THIRDS + 1):
                lo, hi = lines.LEAD + (k - 1) * width, lines.LEAD + k * width
                out.append((k, n, tuple(own[:lo]), tuple(own[hi:])))
        return out

    def part_keys(line):
        parts = passages(line)
        texts = [" ".join(general(p)) for p in parts]
        return [[(0, t.strip(" "), False)] if len(parts) > 1 and len(t) >= lines.STRETCH else [] for t in texts]

    seen = {}
    for doc_id, text in {(r[0], r[1]) for r in rows}:
        own = {t for line in (text or "").split("\n") for t in keys(line)}
        for t in own | {t for line in (text or "").split("\n") for p in part_keys(line) for t in p}:
            seen.setdefault(t, []).append(doc_id)
    first = {}
    for t, ids in seen.items():
        short = t[0] == 0 and t[2]
        known = [i for i in ids if i is not None]
        if len(ids) >= (lines.SHORT_DOCS if short else 2) and known:
            first[t] = min(known)
    out = []
    for doc_id, text, *_ in rows:
        if text is not None:
            gone = lambda own: any(t in first and (doc_id is None or first[t] < doc_id) for t in own)  # noqa: B023, E731
            kept = []
            for line in text.split("\n"):
                if not gone(keys(line)):
                    parts, own = passages(line), part_keys(line)
                    some = [p for p, t in zip(parts, own, strict=True) if not gone(t)]
                    kept.append(line if len(some) == len(parts) else "".join(some).rstrip(" "))
            text = "\n".join(kept)
        out.append((doc_id, text))
    return sorted(out, key=str)


PASSAGE = "the quick brown fox jumps over the lazy dog while 12 other foxes watch from afar and cheer"


def rows():
    out = [(i, f"own words of text number {'abcdefghijklmnop'[i]} and more that no other text has {'xyzuvw'[i % 6]}{i}\n{PASSAGE.replace('12', str(i))}\n\nAll rights reserved.", i, "z", 1) for i in range(1, 9)]
    out += [(20, PASSAGE.replace("lazy", "sleepy"), 0, "", 0), (21, PASSAGE.replace("The quick", "One slow"), 0, "", 0), (22, "a\nb c\n\n", 0, "", 0), (23, "a\nb c", 0, "", 0)]
    out += [(30, None, 0, "", 0), (31, "", 0, "", 0), (32, "line " * 20_000, 0, "", 0), (None, f"{PASSAGE}\nkept because new here by all means it is", 0, "", 0), (2, out[1][1], 0, "", 0)]
    out += [(40, "one short line\n" * 30, 0, "", 0), (41, "one short line\n", 0, "", 0)]
    return out


def test_against_plain_python(spark):
    data = rows()
    got = lines.dedup(spark.createDataFrame(data, SCHEMA), length="n_chars")
    assert got.columns == ["doc_id", "text", "n_chars", "h", "id"]
    kept = got.collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == plain(data)
    assert PASSAGE.replace("12", "1") in next(r.text for r in kept if r.doc_id == 1)  # one copy stays
    assert all("fox" not in (r.text or "") for r in kept if r.doc_id not in (1, 21))
    changed = {r.doc_id: r for r in kept}
    assert changed[3].n_chars == len(changed[3].text) and changed[22].n_chars == 0


def test_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    marked = lines.marked(docs).collect()
    assert sorted(((r.doc_id, r.text) for r in marked), key=str) == plain(data)
    text = dict(data)
    for r in marked:
        n = text[r.doc_id].count("\n") + 1
        assert r["_n_lines"] == n and r["_n_dropped"] == (n if r.text == "" and r["_n_dropped"] == n else n - r.text.count("\n") - 1)
        assert r["_n_cut"] or r["_n_dropped"] or r.text == text[r.doc_id]


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "one short line", 0, "", 0)] * 5 + [(2, "one short line", 0, "", 0)]
    assert [r.text for r in lines.dedup(spark.createDataFrame(rows, SCHEMA)).collect()] == ["one short line"] * 6


def test_passages_inside_lines(spark):
    """A passage of several sentences in the middle of other lines goes from all documents but the first; the words around it stay."""
    passage = "Every copy of this long sentence is the same in all of the texts here. Short one. The second long sentence, with year 1999 in it, closes the shared passage of them all. "
    own = lambda i: f"Text {'abcdefg'[i]} {'abcdefg'[i]} begins with words that nobody else has, up to this stop. "
    after = lambda i: f"What comes after it belongs to {'hijklmn'[i]} alone, and is long enough to count as one."
    rows = [(i, own(i) + passage.replace("1999", str(1999 + i)) + after(i), 0, "", 0) for i in range(5)]
    rows += [(9, rows[3][1] + "\x01 odd", 0, "", 0)]
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == rows[0][1] and got[9] == rows[5][1]
    assert all(got[i] == own(i) + after(i) for i in range(1, 5))
    assert sorted(got.items(), key=str) == plain([r for r in rows if r[0] != 9]) + [(9, rows[5][1])]


def test_columns_of_any_name(spark):
    rows = [(1, PASSAGE, 5, 6, 7, 8, 9), (2, PASSAGE, 1, 2, 3, 4, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own_h int, id int, _n_lines int, _id int, drop int")
    got = lines.dedup(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], (2, "", *rows[1][2:])]


def test_no_python(spark):
    plan = lines.marked(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty(spark):
    assert lines.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_texts_of_one_id_are_documents_of_their_own(spark):
    """A line of two texts that share an id stays in one of them, as it does for two ids; a short one needs as many documents as ever."""
    line = "one line of ten tokens that both of the texts have"
    for first, second in ((7, 7), (7, 8)):
        found = lines.dedup(spark.createDataFrame([(first, f"{line}\nthe first text's own words here", 0, "", 0), (second, f"{line}\nwhat the second text says instead", 0, "", 0)], SCHEMA)).collect()
        assert sorted(line in r.text for r in found) == [False, True]
    nameless = spark.createDataFrame([(None, f"{line}\na", 0, "", 0), (None, f"{line}\nb", 0, "", 0), (3, line, 0, "", 0)], SCHEMA)
    assert [r.doc_id for r in lines.dedup(nameless).collect() if line in r.text] == [3]
