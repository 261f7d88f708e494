"""URL filter, filter audit and conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from millrace.llm import filter_audit, queries, repair, url_filter

WORDS = ["porn", "casino", "Poker", "live", "sex", "news", "bet", "café", "online", "x1", "free"]


def brute_url(url, rules):
    folded = "-" + re.sub(r"[\W_]+", "-", "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")) + "-"
    hits = {kind: {t: (len(re.findall(f"(?=-{re.escape(t)}-)", folded)), w) for t, w in terms} for kind, terms in (("strict", url_filter.STRICT), ("soft", url_filter.SOFT))}
    n = {kind: sum(c for c, _ in own.values()) for kind, own in hits.items()}
    soft = sum(1 for c, _ in hits["soft"].values() if c)
    host = path = ""
    if "://" in (url or ""):
        rest = url.split("://", 1)[1]
        raw = re.split("[/?#]", rest)[0]
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw), re.split("[?#]", rest[len(raw) :])[0]
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda r: len(r[0])) if fits else (None, "block" if n["strict"] or soft >= 2 else "allow")
    return host, path, rule, verdict, n["strict"], n["soft"], soft, sum(c * w for own in hits.values() for c, w in own.values())


def test_urls_against_brute_force(spark):
    rng = random.Random(3)
    hosts = ["example.com", "www.Example.com", "a.b.net", "net", "xnet", "com", "WWW.EXAMPLE.COM:80", "", "é.com"]
    urls = [None, "", "no mark", "://", "http://", "http://com?x/en/", "a://b://c/en/", "http://example.com", "x" * 50_000 + "-porn", "http://essex.org/pornography", "http://a.org/live_SEX", "http://a.org/sex/live"]
    for _ in range(300):
        words = [rng.choice(WORDS) for _ in range(rng.randint(0, 6))]
        urls.append(f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(['/', '/en/', '/es/', '/fr/', '/EN/', '', '?', '#/en/'])}" + "".join(w + rng.choice("-_/.?=&# a%") for w in words))
    rows = [(i, u, "own", i) for i, u in enumerate(urls)] + [(0, urls[20], "own", 1)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, kept string, VERDICT long")
    got = url_filter.judge_urls(df, queries.URL_RULES)
    assert got.columns == ["page_id", "url", "kept", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_terms", "weight"]
    want = sorted((i, repr(u), k, *map(str, brute_url(u, queries.URL_RULES))) for i, u, k, _ in rows)
    assert sorted((r[0], repr(r[1]), r[2], *map(str, r[3:])) for r in got.collect()) == want
    assert {r.verdict for r in got.where("rule is null").collect()} == {"allow", "block"}
    assert url_filter.judge_urls(df.limit(0), queries.URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df, strict=[], soft=[]).collect()} == {"allow"}


def test_many_rules_give_what_each_gives(spark):
    rng = random.Random(5)
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((".".join(rng.choices("abc", k=rng.randint(1, 3))), "/" + "".join(rng.choices("xy/", k=rng.randint(0, 3)))) for _ in range(200))}.values())
    urls = ["http://" + ".".join(rng.choices("abc", k=rng.randint(1, 4))) + "/" + "".join(rng.choices("xy/", k=4)) for _ in range(200)]
    got = {r.url: r for r in url_filter.judge_urls(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    for u in urls:
        host, path, rule, *_ = brute_url(u, rules)
        assert len(got[u].rule or "") == len(rule or "")
    with pytest.raises(ValueError):
        url_filter.Rules([("maybe", "a", "/")])


def brute_audit(docs, labels):
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    parts = {}
    for doc, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        if doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in docs):
            fails.add("E")
        parts.setdefault(lang or "", []).append((fails, doc in good, doc in toxic))
    out = {}
    for part, own in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                fails = sum(f in d[0] for d in own)
                out[part, order, step] = [len(left), len(gone), fails - len(gone), sum(d[0] == {f} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_filter_audit_against_brute_force(spark):
    rng = random.Random(7)
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", "  ", long, long + " #", "ABC " * 300, "a\u00a0b\u2003c", long.upper(), "x y" * 99_000, "é" * 40 + "A" * 2, "one\x0btwo\x1cthree", "Hello, *world*"]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(120)]
    docs += [(i + 100, long, "en") for i in range(60)] + [(100, long, "de")] * 3 + [(7, "same", "en")] * 2
    labels = [(rng.choice([None, *range(150)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(90)]
    given = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, mask string, n long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit.audit_documents(given, marks).collect()}
    assert got == brute_audit(docs, labels)
    assert filter_audit.audit_documents(given.limit(0), marks).count() == 0
    bare = {k: v[4:6] for k, v in ((k, v) for k, v in brute_audit(docs, []).items())}
    none = {(r.part, r.filter_order, r.step): list(r)[7:9] for r in filter_audit.audit_documents(given, marks.limit(0)).collect()}
    assert none == bare


def test_removal_steps_are_a_min_plus_product():
    orders = np.array(list(itertools.permutations(range(4))))
    steps = filter_audit.removal_steps(4, orders)
    for mask, (k, order) in itertools.product(range(16), enumerate(orders)):
        hit = [i + 1 for i, f in enumerate(order) if mask >> f & 1]
        assert steps[mask, k] == hit[0] if hit else steps[mask, k] > 4
    with pytest.raises(ValueError):
        filter_audit.interaction_audit(None, "ABC", ["ABB"])


#: Roles allowed after a state, with the state they lead to.
AUTOMATON = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def relaxed(rows):
    """(cost, audit, [(role, row or None)]) by relaxing every edit, insertions of any role anywhere. rows: (initial, fault)."""
    best = {(0, ""): (0, "", ())}
    todo = [(0, "")]

    def offer(node, cost, audit, kept):
        if node not in best or (cost, audit) < best[node][:2]:
            best[node] = (cost, audit, kept)
            todo.append(node)

    while todo:
        i, state = node = todo.pop(0)
        cost, audit, kept = best[node]
        for role in "ua":
            if role in AUTOMATON[state]:
                offer((i, AUTOMATON[state][role]), cost + 3, audit + "I", (*kept, (role, None)))
        if i < len(rows):
            initial, fault = rows[i]
            offer((i + 1, state), cost + 4, audit + "D", kept)
            if fault in ("", "truncated"):
                more = 3 * (fault == "truncated")
                if initial in AUTOMATON[state]:
                    offer((i + 1, AUTOMATON[state][initial]), cost + more, audit + "K", (*kept, (None, i)))
                for role in "ua":
                    if role in AUTOMATON[state]:
                        offer((i + 1, AUTOMATON[state][role]), cost + more + 3, audit + "R", (*kept, (role, i)))
    return min(best[k] for k in ((len(rows), ""), (len(rows), "a")) if k in best)


def exhaustive(rows):
    """(cost, audit) over all scripts with up to two insertions in each gap."""
    gaps = ["".join(p) for n in range(3) for p in itertools.product("ua", repeat=n)]
    acts = [[("D", "", 4)] + ([] if fault in ("blank", "duplicate") else [("K", initial, 3 * (fault == "truncated")), *[("R", r, 3 + 3 * (fault == "truncated")) for r in "ua"]]) for initial, fault in rows]
    best = None
    for own in itertools.product(*acts):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            roles = ins[0] + "".join(a[1] + g for a, g in zip(own, ins[1:]))
            if re.fullmatch("(s?(ua)+)?", roles):
                found = (sum(a[2] for a in own) + 3 * len("".join(ins)), "I" * len(ins[0]) + "".join(a[0] + "I" * len(g) for a, g in zip(own, ins[1:])))
                best = min(best or found, found)
    return best


FAULTS = ["", "truncated", "blank", "duplicate"]


def coded(rows):
    return bytes(4 * ("sua".index(i) if i in "sua" else 3) + FAULTS.index(f) for i, f in rows)


def test_edits_against_all_scripts():
    rng = random.Random(1)
    draw = lambda n: [(rng.choice("suax"), rng.choice(["", "", *FAULTS])) for _ in range(n)]
    for n in (0, 1, 2, 2, 2, 3, 3, 3):
        rows = draw(n)
        cost, edits, more = repair.edits_of(coded(rows), 1)
        assert (cost, "".join(edits) + "I" * more) == exhaustive(rows) == relaxed(rows)[:2]
    for _ in range(1500):
        rows = draw(rng.randint(0, 14))
        cost, edits, more = repair.edits_of(coded(rows), rng.choice([1, 2, 5]))
        assert (cost, "".join(edits) + "I" * more) == relaxed(rows)[:2], rows


def test_divide_and_conquer_equals_one_table():
    rng = random.Random(2)
    for n in (300, 1000, 5000):
        own = bytes(rng.choice([0, 4, 4, 5, 6, 7, 8, 8, 9, 12]) for _ in range(n))
        assert repair.edits_of(own, 3) == repair.edits_of(own, 10**9) == repair.edits_of(own)
        forward = repair.forward(own, repair.START)[0]
        assert min(f + 3 * repair.ENDING[s] for s, f in enumerate(forward)) == repair.edits_of(own)[0]
        assert min(repair.backward(own, s)[0] + 3 * repair.ENDING[s] for s in range(4)) == repair.edits_of(own)[0]


def brute_repair(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        lines = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = "user" if kind == 4 else " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            lines += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
        lines.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).hexdigest()))
        seen, found = set(), []
        for _, role, text in lines:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            found.append((role[:1], "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""))
            seen.add((role, text))
        cost, audit, kept = relaxed(found)
        full = {"u": "user", "a": "assistant"}
        text = "\n".join(f"{full[r] if r else lines[i][1]}:{lines[i][2] if i is not None else ''}" for r, i in kept)
        turns = {t for t, *_ in lines if t is not None}
        pairs = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        faults = [sum(f == k for _, f in found) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, pairs, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


@pytest.mark.parametrize("stretch", [2, 1024])
def test_repair_against_brute_force(spark, stretch):
    rng = random.Random(11)
    texts = [None, "", " \n", "One.", "two", "Three!\n ", "Four? ", "é…", "x." * 500, ".", "¿Qué?"]
    roles = [None, "", "user", "user", "assistant", "assistant", "system", "User", "tool", "u", "assistant2"]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(500)]
    rows += [(c, t, "system" if t == 0 else "user" if t % 2 else "assistant", f"text {c} {t}.") for c in range(100, 180) for t in range(rng.randint(1, 12))]
    rows += [(200, t, rng.choice(roles), rng.choice(texts)) for t in range(-5, 700)] + [(201, 5, "user", "again.")] * 40
    given = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, side int")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_conversations(repair.damaged(given), stretch).collect()}
    assert got == brute_repair(rows)
    assert repair.repair_conversations(repair.damaged(given.limit(0))).count() == 0


def test_lost_conversations_stay(spark):
    lost = [next(c for c in range(10**6) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)]
    rows = spark.createDataFrame([(c, 1, "user", "Hi.") for c in lost], "conv_id long, turn long, role string, text string")
    r = repair.repair_conversations(repair.damaged(rows)).first()
    assert tuple(r) == (lost[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
