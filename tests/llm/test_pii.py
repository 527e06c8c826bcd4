"""Base spans against plain regular expressions, and bootstrapped secrets."""

import random
import re

from supplymetrics.llm import pii

from .conftest import EDGE, documents


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)]


def plain(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in BASE for m in re.finditer(p, text or "") if ok(m[0]))


def test_base_spans_match_plain_expressions(spark):
    rng = random.Random(11)
    parts = ["a@b.co", "x.y%z@h-1.org.net", "@", "a@b", "_d@e.f", "1.2.3.4", "256.1.1.1", "0255.000.1.9", "1.2.3.4.5.6.7.8.9", ".", "4111 1111-1111 1111",
             "4111111111111112", "378282246310005", "+1 (415) 555-2671", "+49.30.901820", "+1", "+12 345", " ", "  ", "-", "é", "\U0001f600", "\n", "word",
             "12", "+", "(", ")", "%", "0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    texts += ["a@b.com_x@c.de", "9" * 20_000, "1 " * 9000, "1." * 9000, "a" * 50_000 + "@", "+" * 500 + "1-" * 20_000, "a1" * 40_000, "a@" * 5000]
    found = {r.doc_id: r.base for r in pii.find_pii(documents(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert found[i] == plain(t), t[:200]


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 4)) + "1f2e"
    rows, wanted = [], {}
    for i in range(120):
        text = " ".join(word() for _ in range(20)) + " "
        made = []
        for kind in rng.sample(["seed", "same", "other", "prose", "none"], 2):
            before, token = {"seed": ('token = "', hexa(40)), "same": ('token = "', hexa(27)), "other": ("passwd=", hexa(18)),
                             "prose": (f"{word()} ", hexa(18)), "none": ("", word())}[kind]
            if kind in ("seed", "same", "other"):
                made.append((len(text) + len(before), len(text) + len(before) + len(token)))
            text += before + token + " " + word() + " "
        rows.append((i, text + "call +1 (415) 555-2671", "en", "s"))
        wanted[i] = made
    return rows, wanted


def test_bootstrap_finds_unseen_identifiers(spark):
    rows, wanted = corpus()
    found = pii.find_pii(documents(spark, rows)).collect()
    for r in found:
        secrets = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("secret")]
        assert secrets == wanted[r.doc_id]
        assert r.spans.startswith(r.base) and r.n_phone == 1 and r.n_secret == len(secrets)


def test_hot_pattern_of_few_instances_is_not_support(spark):
    rows = [(i, 'key = "0123456789abcdef0123456789abcdef01234567" and key = "zzzz9999yyyy"', "en", "s") for i in range(200)]
    found = pii.find_pii(documents(spark, rows)).collect()
    assert {r.spans for r in found} == {"secret:7:47"}


def listed(spark, texts):
    found = pii.find_pii(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    return {texts[r.doc_id][int(a):int(b)] for r in found for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "secret"}


def test_base_entities_seed_patterns_of_digits(spark):
    hidden = ["123-45-6789", "987654321", "C01234567", "zq81xw20pl"]
    texts = [f"you can contact u{i}@mail.org any day" for i in range(8)] + [f"you can contact {h} any day" for h in hidden]
    assert listed(spark, texts + [f"some other words 2024-01-{i:02} here" for i in range(10, 30)]) == set(hidden)
    assert listed(spark, texts[:3] + texts[8:]) == set()  # too few known instances


KEY = "0123456789abcdef" * 2 + "0123456"  # with a digit more it has the format of a seed
KEYS = {KEY + c for c in "0123456789abcdef"}


def test_items_of_a_list_share_the_text_before_it(spark):
    texts = [f"api token = {k} and that is it" for k in sorted(KEYS)]
    hidden = [(f"zz{i}12345678", f"yy{i}8765432{i}", f"xx{i}1111{i}") for i in range(4)]
    texts += [f"some text api token = {a} {b}, {c}; end" for a, b, c in hidden] + ["api token = q1w2e3r4t5 unlike zz11223344 here"]
    assert listed(spark, texts) - KEYS == {x for h in hidden for x in h} | {"q1w2e3r4t5"}


def test_identifiers_named_on_their_right(spark):
    texts = [f"{k} is the api token of {k[-1]}" for k in sorted(KEYS)]
    hidden = [f"zz{i}12345678" for i in range(10)]
    texts += [f"{chr(97 + i)} knows that {h} is the api token" for i, h in enumerate(hidden)] + [f"in aa{i}2345678 was no such thing" for i in range(20)]
    assert listed(spark, texts) - KEYS == set(hidden)


def test_context_reaches_over_tokens_and_never_cuts_a_piece(spark):
    # the token before is a piece of the pattern, and pieces that are too long to be whole give none
    texts = [f"user ab1234567 has {KEY}{i} now" for i in range(6)] + ["user ab1234567 has cd76543210 now"]
    texts += [f"{'w' * 300} is {KEY}{i}" for i in range(6)] + [f"{'v' * 10}{'w' * 290} is ef76543210"]
    assert listed(spark, texts) - {f"{KEY}{i}" for i in range(6)} == {"cd76543210"}


def plain_added(texts, min_support=5, min_confidence=.4):
    """The added spans by plain loops over the texts: (text number, start, end)."""
    token = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}")
    seeded = re.compile(r"^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{40})$")
    entities = []  # (text, start, end, instance, patterns, base)
    for k, t in enumerate(texts):
        spans = [(m.start(), m.end()) for _, p, ok in BASE for m in re.finditer(p, t) if ok(m[0])]
        list_before = None
        last = 0
        for m in token.finditer(t):
            if not re.search("[0-9]", m[0]):
                continue
            gap = t[last:m.start()]
            if not (last and re.fullmatch(r"[\s,;|]+", gap)):
                list_before = "\n" + t[:m.start()]
            last = m.end()
            if not any(a < m.end() and m.start() < b for a, b in spans):
                entities.append((k, m.start(), m.end(), m[0], patterns(list_before, t[m.end():] + "\n"), False))
        entities += [(k, a, b, t[a:b], patterns("\n" + t[:a], t[b:] + "\n"), True) for a, b in spans]
    seed = {(e[3], p) for e in entities for p in e[4] if e[5] or seeded.match(e[3])}
    graph = {(e[3], p) for e in entities for p in e[4]}
    known = set()
    while True:
        trusted = set()
        for p in {p for _, p in graph}:
            own = {i for i, q in graph if q == p}
            support = sum((i, p) in seed or i in known for i in own)
            if support >= min_support and support >= min_confidence * len(own):
                trusted.add(p)
        more = {i for i, p in graph if p in trusted and (i, p) not in seed and len(digits(i)) >= 2} | known
        if more == known:
            break
        known = more
    return sorted({(k, a, b) for k, a, b, i, ps, base in entities if not base and (seeded.match(i) or i in known and trusted & set(ps))})


def patterns(before, after):
    before, after = (re.sub("[0-9]", "0", x.lower()) for x in (before[-200:], after[:200]))
    found = (("pieces", re.search(r"\s(\S+\s+\S+\s+\S*)\Z", before)), ("glued", re.search(r"\s(\S+)\Z", before)),
             ("sign", re.search(r"([=:])\s*[\"'`(\[<]*\s*\Z", before)), ("following", re.match(r"([^\sa-z]*\s+\S+\s+\S+)\s", after)))
    return [f"{name} {m[1]}" for name, m in found if m and m[1]]


def test_added_spans_match_plain_loops(spark):
    rng = random.Random(21)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    near = lambda: "".join(rng.choice("ghijkmnp0123456789") for _ in range(rng.randint(8, 14)))
    parts = ["api token = ", "my key: ", "the ", "user ", " is the code ", ", ", " ", "\n", " id=\"", "\" ", "mail a@b.org ", "from 10.0.0.1 ", "word ", "; "]
    texts = ["".join(rng.choice(parts) + (rng.choice([key, near, near])() if rng.random() < .6 else "") for _ in range(rng.randint(1, 8))) for _ in range(250)]
    found = pii.find_pii(documents(spark, list(enumerate(texts)))).collect()
    got = sorted((r.doc_id, int(a), int(b)) for r in found for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "secret")
    want = plain_added(texts)
    assert got == want and len(want) > 100


def test_rounds_go_on_while_anything_is_learned(spark):
    links = 9  # every context is known from the one before only
    token = lambda k, i: f"q{k}w{i}e77r{k * 10 + i:04}"
    texts = [f"link no 0x {'0123456789abcdef' * 2}0123456{i} end" for i in range(6)] + [f"link no 0x {token(0, i)} end" for i in range(6)]
    for k in range(1, links):
        texts += [f"link no {chr(97 + k)}x {token(k - 1, i)} end" for i in range(6)] + [f"link no {chr(97 + k)}x {token(k, i)} end" for i in range(6)]
    found = listed(spark, texts)
    assert {token(k, i) for k in range(links) for i in range(6)} <= found


def test_edges(spark, edge, none):
    found = pii.find_pii(edge).collect()
    want = sorted((r[0] or 0, plain(r[1])) for r in EDGE)
    assert sorted((r.doc_id or 0, r.base) for r in found) == want
    assert pii.find_pii(none).count() == 0


def test_plan_has_no_python(spark, capsys):
    rows, _ = corpus()
    pii.find_pii(documents(spark, rows).repartition(3)).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan
