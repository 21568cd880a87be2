import hashlib
import random
import re

from lodestone.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    return {k: [m.span() for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in BASE.items()}


ODD = [
    None, "", "a@b.c_d@e.f", "x..y@-a-.b.c.@z.q 1.2.3.4.5.6.7.8 00255.0.0.001 256.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 5500000000000004",
    "é🙂 +1 (785) 555-9526, +44 20 7946 0958. +12 +1234567 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "@@ a@b a@b. a@b.c. @x.y %@%.% +-@q.w", "1" * 3000 + "@x.y" + ".z" * 6000, "12 " * 9000, "9" * 20000, "+1((((((" + "(" * 5000,
    "tel +1-202-555-0143 ip 10.0.0.1:80 a.b+c@d-e.co.uk, <me@you.org>", "1 2 3 4 5 6 7 8 9 0 1 2 3 5",
]


def test_base_spans_against_brute_force(spark):
    rng = random.Random(9)
    soup = ["".join(rng.choice("01259 .+-()@ab:\n") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    rows = list(enumerate(ODD + soup)) + [(None, "me@x.org"), (3, "again 8.8.8.8")]
    docs = spark.createDataFrame([(i, t, 1, "e") for i, t in rows], "doc_id long, text string, row int, email string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.personal_data(docs).collect())
    want = []
    for i, t in rows:
        b = brute(t)
        joined = ",".join(f"{k}:{s}:{e}" for k in BASE for s, e in b[k])
        want.append((-1 if i is None else i, *(len(b[k]) for k in BASE), hashlib.sha256(joined.encode()).hexdigest()))
    assert got == sorted(want)


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"Intro {i}. Please call me at +1 202 555 {1000 + i} after noon.") for i in range(6)]
    rows += [(50, "So please call me at 202 555 7788 after noon."), (51, "In 2019 there were 12345 of them."), (52, "Please call me at home.")]
    rows += [(60 + i, f"write to user{i}@site.org thanks") for i in range(5)] + [(70, "please write to bob(at)site.org thanks"), (71, "odd thing bob(at)home here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.n_added) for r in pii.personal_data(docs).collect()}
    at = rows[6][1].index("202")
    assert got[50] == (f"phone:{at}:{at + 12}", 1)
    assert got[70] == ("email:16:31", 1)
    assert all(got[i][1] == 0 for i in got if i not in (50, 70))
    assert got[60][0] == "email:9:23"


def test_empty_table(no_docs):
    assert pii.personal_data(no_docs).collect() == []


def test_punctuation_around_seeds_and_unseen_identifiers(spark):
    """Seeds before commas and in brackets count; 60 planted identifiers that no base pattern takes."""
    rows = [(i, f"Please write to user{i}@site.org, thanks for {i % 7} days.") for i in range(60)]
    rows += [(100 + i, f"Call the office (on +1 202 555 {1000 + i}), or wait.") for i in range(60)]
    planted = {}
    for i in range(30):
        text = f"Then please write to name{i}(at)home{i}.org, thanks."
        planted[200 + i] = ("email", text.index("name"), text.index(", thanks"))
        rows.append((200 + i, text))
        text = f"Call the office (on 0{300 + i} 44 55 {10 + i}), or wait."
        planted[300 + i] = ("phone", text.index("(on") + 4, text.index("), or"))
        rows.append((300 + i, text))
    clean = [(400 + i, f"In {1900 + i} some {1000 * i + 12345} people came at {i}:30 to see it (on day {i}), or left it.") for i in range(40)]
    docs = spark.createDataFrame(rows + clean, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    hit = [i for i, (kind, a, b) in planted.items() if got[i].spans == f"{kind}:{a}:{b}"]
    assert len(hit) >= 0.9 * len(planted)
    assert all(got[i].n_added == 0 for i in got if i not in planted)
