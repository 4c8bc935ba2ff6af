import re

import pytest

from tapedeck.llm import licenses
from tests.llm.fixtures import awkward, edited, frame, prose

BSD = licenses.TEMPLATES[4][0]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    w, places = words(text), []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))


DOCS = [
    (20, "Licensed under CC BY-NC 4.0. All rights\nreserved, all RIGHTS reserved"),
    (21, "cc by cc by cc by general public license general public general public license"),
    (22, f"{prose(1, 40)} This work is licensed under the GNU General Public License, version 3. {prose(2, 10)}"),
    (23, "all rights reserve d. occ by; cc bye; cc\x00by, CC BY, ccé by"),
    (24, "cc by " * 4000),
    (25, f"{prose(3, 20)} {BSD}"),
    (26, f"{prose(3, 20)} {edited(BSD, [9, 16])} {prose(4, 9)}"),
    (27, f"{BSD.replace('source and', 'source form and also')} {prose(4, 9)}"),
    (28, " ".join(BSD.split()[:14])),
    (29, "released under the MIT license"),
    (29, "released under the MIT license"),
    (29, "general public license"),
    (None, "all rights reserved"),
    (30, "by"), (31, "cc"), (32, "cc by"),
]


def test_base_places_of_awkward_rows(spark):
    docs = awkward() + DOCS
    rows = licenses.scan(frame(spark, docs)).collect()
    want = sorted(((d, *base(t)) for d, t in docs), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=repr) == want
    assert all(0 <= r.score <= 1 and (r.score == 1 or not r.n_base) and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} for r in rows)


def test_notices_with_changes(spark):
    got = {r.doc_id: r for r in licenses.scan(frame(spark, DOCS)).where("doc_id is not null").collect()}
    assert {d for d, r in got.items() if "bsd" in r.labels} == {25, 26, 27}
    assert got[20].labels == "cc-by,cc-by-nc,reserved" and got[22].labels == "gpl" and got[25].score == 1
    assert 0.8 <= got[26].score < 1 and [(s.label, s.first_word, s.n_words) for s in got[26].spans] == [("bsd", 20, 21)]
    assert [(s.label, s.first_word, s.n_words) for s in got[27].spans] == [("bsd", 0, 23)]
    assert 0.5 < got[28].score < 0.8 and got[28].labels == ""


def test_own_templates_and_joins_without_broadcast(spark, monkeypatch):
    docs = frame(spark, [(1, "x a b c d y a b c d"), (2, "a b"), (3, None)])
    how = {"phrases": [("a b", "ab")], "templates": [("a b c d", "abcd")]}
    want = [(1, 10, 2, 1, 6, "ab", "ab,abcd", 1.0), (2, 2, 1, 0, 0, "ab", "ab", 1.0), (3, 0, 0, None, None, "", "", 0.0)]
    assert sorted(tuple(r)[:8] for r in licenses.scan(docs, **how).collect()) == want
    monkeypatch.setattr(licenses, "MOST_GRAMS", 0)
    assert sorted(tuple(r)[:8] for r in licenses.scan(docs, **how).collect()) == want
    for bad in ("one", "a-b c", "w " * 61):
        with pytest.raises(ValueError):
            licenses.scan(docs, phrases=[(bad, "x")])


def test_empty_table_and_no_python(spark):
    assert licenses.scan(frame(spark, [])).count() == 0
    plan = licenses.scan(frame(spark, DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
