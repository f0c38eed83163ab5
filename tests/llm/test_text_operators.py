"""Operators on single texts and pages, held against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from datarill.llm.common import materialize
from datarill.llm import byte_bpe, decontaminate, html_text, pii, quality_rules, secrets, toxicity, url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, source=lambda i: f"s{i % 3}"):
    return spark.createDataFrame([(i, t, "en", source(i), len(t or "")) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \n\t ", "a", "ß\u2028\u0085x\x1c y", "x" * 30000, "a b c\n" * 4000, "\U0001f600 \u0301"]


def test_every_operator_takes_odd_rows_empty_tables_and_extra_columns(spark):
    d = docs(spark, ODD).withColumn("N_WORDS", F.lit(1)).withColumn("score", F.lit("x")).withColumn("fp", F.lit(0))
    d = d.unionByName(d)  # repeated rows
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six seven eight nine")], "item_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame([(3, None)], "doc_id long, label int"))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    runs = {
        "toxicity": lambda x: toxicity.score_texts(x, model),
        "pii": pii.find_pii,
        "secrets": secrets.find_secrets,
        "quality": quality_rules.judge_quality,
        "bpe": lambda x: byte_bpe.round_trip(x, path),
    }
    for name, f in runs.items():
        assert f(d).count() == 2 * len(ODD), name
        assert f(d.limit(0)).count() == 0, name
    assert decontaminate.find_leaks(d, bench).count() == 0
    assert decontaminate.drop_contaminated(d, bench.limit(0)).count() == 2 * len(ODD)


# ---- personal data

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", pii.valid_card),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= sum(c.isdigit() for c in s) <= 15),
}


def test_pii_base_matches_the_plain_patterns():
    r = random.Random(5)
    for _ in range(5000):
        text = "".join(r.choice("ab1@.+- ()29x\n") for _ in range(r.randint(0, 50)))
        plain = sorted(((*m.span(), k) for k, (p, ok) in BASE.items() for m in re.finditer(p, text) if ok(m.group())), key=lambda s: (s[0], pii.KINDS.index(s[2])))
        assert pii.base_spans(text) == plain, text


def test_viterbi_is_exact():
    t = pii.train(epochs=5)
    r = np.random.RandomState(0)
    t.move = r.randn(5, 5)
    rows = [r.randn(n, 5) for n in (1, 4, 2, 4, 3)]
    for x, got in zip(rows, t.viterbi(rows)):
        from itertools import product

        score = lambda s: sum(x[i, k] for i, k in enumerate(s)) + sum(t.move[a, b] for a, b in zip(s, s[1:]))
        assert score(got) == pytest.approx(max(score(s) for s in product(range(5), repeat=len(x))))


HELD_OUT = """
Reach me under [phone:(646) 555-0188] any day
our line is [phone:212-555-0119] until five
phone [phone:+1 646 555 0170] please
fax: [phone:020 7946 0321] office
call [phone:(030) 901 8201] or write
ring [phone:555.014.7781] now
my mobile is [phone:0171 5550987] .
tel: [phone:1-888-555-0147]
questions go to [email:mia dot roe at example dot org]
write [email:office [at] shop.example [dot] com] today
mail [email:tom (at) example (dot) net] for it
[email:lee at post dot example dot org] will answer
contact [email:desk@example.org], please
send it to [email:a.b.c@mail.example.com] soon
or use [email:help [at] example [dot] de] .
the host [ip:198[.]51[.]100[.]200] is down
login from [ip:10.2.3.4] at noon
blocked [ip:203 dot 0 dot 113 dot 77] yesterday
see [ip:192.0.2[.]5] in the log
charged to [card:4012 8888 8888 1881] today
card [card:5555-5555-5555-4444] expired
visa [card:4111111111111111] was used
try [phone:718-555-0126] after lunch
the desk answers on [phone:(808) 555-0193]
you find me as [email:kay at lists dot example dot net] there
[email:uwe [at] haus.example [dot] de] weiss mehr
bis dann unter [phone:0151 5550143] oder [email:uwe@example.de]
gateway [ip:172.31.0.1] and peer [ip:172[.]31[.]0[.]2]
there were 1,204 of them in 1987
the score was 21-14-7 in the end
he has 555 friends and 0100 problems
section 7.3.2 and page 114
we met at 6 dot on the map
she was at home at noon with us
version 3.1.4 of the guide
he paid 14.99 for 2 of 3
the train at 10:42 is late
room 12, floor 4, building 9
in 2011 and again in 2019
a ratio of 2.5 to 1 at best
call it a day at 9
the number 42 is the answer
order 20394817 is on its way
""".strip().split("\n")


def test_tagger_learns_its_table_and_finds_held_out_spans(spark):
    t = pii.train()
    wrong = [text for text, spans in pii.read_examples(pii.EXAMPLES) if pii.tag([text], t)[0] != spans]
    assert len(wrong) <= 3, wrong
    assert not set(HELD_OUT) & set(pii.EXAMPLES)
    pairs = [(set(spans), set(pii.spans_of([text], t)[0][1]), text) for text, spans in pii.read_examples(HELD_OUT)]
    hit, gold, found = (sum(map(len, x)) for x in ([g & f for g, f, _ in pairs], [g for g, _, _ in pairs], [f for _, f, _ in pairs]))
    assert hit / gold >= 0.9 and hit / found >= 0.9, (hit, gold, found, [p for p in pairs if p[0] != p[1]])
    text = "Ring (415) 555-0182 or mail zoe@example.org"
    (base, every), = pii.spans_of([text], t)
    assert [k for *_, k in base] == ["email"] and {(text[a:b], k) for a, b, k in every} == {("(415) 555-0182", "phone"), ("zoe@example.org", "email")}
    row = pii.find_pii(docs(spark, [text]), t).first()
    assert row["n_email"] == 1 and row["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
    assert pii.find_pii(docs(spark, [None]), t).first()["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_segments_cut_no_token_and_stay_apart():
    t = pii.train()
    local = "x" * 63
    for text, span in [(f"mail {local} at example dot com now", f"{local} at example dot com"), (f"to {'.'.join('abcdefghijklmnopqrstuvwxyz')} [at] example [dot] org .", "a.b.c")]:
        (_, every), = pii.spans_of([text], t)
        assert any(k == "email" and text[a:b].startswith(span) and b > text.index("at") for a, b, k in every), every
    r = random.Random(6)
    for _ in range(300):
        text = "".join(r.choice(["1", "a", " ", "\n", " at ", " dot ", "@", "word" * 15]) for _ in range(r.randint(0, 60)))
        found = pii.segments(text)
        assert all(a < b for a, b in found) and all(x[1] < y[0] or text[x[1] : y[0]].isspace() or x[1] <= y[0] for x, y in zip(found, found[1:]))
        for a, b in found:
            assert (a == 0 or text[a - 1].isspace()) and (b == len(text) or text[b].isspace())
        covered = [any(a <= m.start() and m.end() <= b for a, b in found) for m in pii._TRIGGER.finditer(text)]
        assert all(covered)


# ---- secrets


def test_secret_base_matches_the_plain_patterns():
    r = random.Random(2)
    both = lambda w: "".join(f"[{c.upper()}{c}]" for c in w)
    assign = "(?:" + "|".join([*map(both, ("password", "passwd", "secret", "token")), both("api") + "_?" + both("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    plain = {"assign": (assign, lambda m: len(m[1]) >= 12), "access": ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), "hex": ("[0-9a-f]+", lambda m: len(m[0]) >= 16)}
    words = ["token", "AKIA", "api_key", "PASSWORD", "\u017fecret", "toKen", " ", "=", ":", '"', "'", "abcdef0123456789", "X9", ".", "KEY", "AKIAABCDEFGHIJKLMN1", "\n"]
    for _ in range(5000):
        text = "".join(r.choice(words) for _ in range(r.randint(0, 12)))
        want = sorted(((*m.span(), k) for k, (p, ok) in plain.items() for m in re.finditer(p, text) if ok(m)), key=lambda s: (s[0], secrets.KINDS.index(s[2])))
        assert secrets.base_spans(text) == want, text


WORDS = secrets.Dictionary(secrets.read_words())


def test_guess_cost_orders_values():
    easy = ["password", "changeme", "12345678", "qwertyuiop", "abcabcabcabc", "P@ssw0rd2024", "2024-01-31", "important", "unavailable", "Wednesday", "collaboration"]
    hard = ["xkT9#mQ2vL", "zX8$kLp0QwRt", "9fQz-71LmmV2"]
    cost = lambda v: secrets.guess_cost(v, WORDS)
    assert max(map(cost, easy)) < secrets.GUESSES <= min(map(cost, hard))
    for v in hard:  # stopping early never turns a verdict
        assert secrets.guess_cost(v * 10, WORDS, secrets.GUESSES) >= secrets.GUESSES
    base, every = secrets.spans_of("pwd: xkT9#mQ2vL. The passphrase is changeme; token=abcdef012345", WORDS)
    assert [s for s in every] == [(5, 15, "guess"), (45, 63, "assign")] and [k for *_, k in base] == ["assign"]


def plain_cost(value, words):
    """The least cost over all segmentations: every piece is looked at on its own."""
    low, best = value.lower(), [0.0]
    place = {c: (r, i + r * 0.5) for r, row in enumerate(("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")) for i, c in enumerate(row)}
    near = lambda a, b: a in place and b in place and a != b and abs(place[a][0] - place[b][0]) <= 1 and abs(place[a][1] - place[b][1]) <= 1
    one = lambda c: 1.0 if c.isdigit() else math.log10(26 if c.isalpha() else 33) if c.isascii() else 2.0
    leet = lambda t: "".join(dict(zip("0134578@$!", "oleastbasi")).get(c, c) for c in t)
    for j in range(1, len(value) + 1):
        found = [best[j - 1] + one(value[j - 1])]
        for i in range(j):
            piece, n = low[i:j], j - i
            if n >= 3 and all(near(a, b) for a, b in zip(piece, piece[1:])):
                found.append(best[i] + 1.7 + 0.35 * (n - 1))
            if n >= 3 and len({ord(b) - ord(a) for a, b in zip(piece, piece[1:])}) == 1 and abs(ord(piece[1]) - ord(piece[0])) == 1:
                found.append(best[i] + 1.4 + math.log10(n))
            for p in range(1, 9):
                if n >= max(2 * p, 3) and piece[p:] == piece[:-p]:
                    found.append(best[i] + min(sum(map(one, value[i : i + p])), max(0.0, best[i + p] - best[i])) + math.log10(n / p) + 0.3)
            for word, turned in ((piece, 0.0), (leet(piece), 0.6)):
                if n >= 2 and word in words:
                    found.append(best[i] + words[word] + turned + 0.3 * (value[i:j] != piece) + 0.3)
                    break
            for m in secrets._DATES.finditer(value):
                if m.span() == (i, j):
                    found.append(best[i] + (2.1 if n == 4 else 4.6))
        best.append(min(found))
    return best[-1]


def test_guess_cost_is_the_least_over_all_segmentations():
    r = random.Random(8)
    parts = ["pass", "Word", "123", "qwe", "aaa", "2024", "-", "x", "Z9", "abc", "@", "dr4gon", "\u00e9", "lkj", "1999-12-31"]
    for _ in range(400):
        value = "".join(r.choice(parts) for _ in range(r.randint(1, 6)))[:20]
        assert secrets.guess_cost(value, WORDS) == pytest.approx(plain_cost(value, WORDS)), value


def test_secrets_of_a_held_out_table():
    """Values that the dictionary and the bound were not made for: random ones, and what people write instead."""
    r = random.Random(99)
    alphabets = ["abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789", "".join(map(chr, range(33, 127)))]
    drop = str.maketrans("", "", "\"'<>,;" + secrets._CLOSING)
    hard = [v for _ in range(300) if len(v := "".join(r.choices(r.choice(alphabets), k=r.randint(10, 24))).translate(drop)) >= 10]
    frames = ["pwd: {}", "the password is {}", "client_secret = '{}'", "Bearer {}", "api-key={}", "passphrase: {}, keep it"]
    caught = sum(any(k in ("guess", "assign") and text[a:b].endswith(v) for a, b, k in secrets.spans_of(text, WORDS)[1]) for v in hard for text in [r.choice(frames).format(v)])
    easy = (
        "important unavailable Wednesday collaboration required documented yesterday wrong expired needed incorrect invalid yourself hunter2 letmein123 changeme monkey12 "
        "qwerty123 password1 administrator welcome1 Summer2024 iloveyou 11111111 abcdefgh zxcvbnm, placeholder your-password my_secret example123 correcthorse somewhere "
        "something different nowhere confidential encrypted rotated automatically compulsory optional-value test1234 sunshine99 football10"
    ).split()
    wrong = sum(any(k == "guess" for *_, k in secrets.spans_of(f.format(v), WORDS)[1]) for v in easy for f in frames[:2])
    assert caught / len(hard) >= 0.95 and wrong / (2 * len(easy)) <= 0.05, (caught, len(hard), wrong, len(easy))


# ---- quality


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, spots = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            spots.update(p for i in at for p in range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(spots)


def test_quality_measures_match_brute_force(spark):
    r = random.Random(4)
    texts = ODD + ["".join(r.choice(["a", "b", "the", "#", " ", " ", "\n", "|", "."]) for _ in range(r.randint(0, 300))) for _ in range(60)] + ["one two three four five six seven eight nine " * 4]
    got = {x["doc_id"]: x for x in quality_rules.judge_quality(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, rep = brute_quality(t)
        assert tuple(got[i][c] for c in quality_rules.BASE) == (n, chars, symbols, dup, rep), repr(t)[:80]
        assert got[i]["base_failed"] == (n < 20 or 100 * rep > 30 * n)
    kept = quality_rules.filter_quality(docs(spark, texts))
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(i for i in got if got[i]["kept"]) and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clash = docs(spark, texts).withColumn("N_WORDS", F.lit(1)).withColumn("kept", F.lit("x"))
    assert quality_rules.filter_quality(clash).count() == kept.count()


def test_quality_adapts_to_its_group(spark):
    plain = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(20)]
    marked = [" ".join(f"w{i}x{j}#" if j % 2 else f"v{j}" for j in range(40)) for i in range(20)]
    d = docs(spark, plain + marked, source=lambda i: "plain" if i < 20 else "marked").unionByName(docs(spark, marked[:1], source=lambda i: "plain").withColumn("doc_id", F.lit(99).cast("long")))
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge_quality(d).collect()}
    assert all(got[i] for i in range(40)) and not got[99]


def test_quality_limits_come_from_the_summaries(spark):
    """Rejects labelled junk and keeps labelled clean texts that pass the base rule, with no limit but those of the groups; the same however limits are joined."""
    d = "/root/testdata/sf0.01"
    docs_ = spark.read.parquet(f"{d}/documents.parquet")
    judged = quality_rules.judge_quality(docs_)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in judged.collect() if r["doc_id"] in labels and not r["base_failed"]]
    assert np.mean([r["kept"] for r in rows if labels[r["doc_id"]] == 1]) > 0.98
    assert np.mean([r["kept"] for r in rows if labels[r["doc_id"]] == 0]) < 0.05
    measured = materialize(quality_rules.measure(docs_.select("doc_id", "lang", "source", "text")).drop("text"))
    limits = quality_rules.thresholds(measured, "lang", "source").collect()
    assert len(limits) > 50 and all(len({r[f"limit_{m}"] for r in limits}) >= 4 for m in quality_rules.FENCES)
    both = [sorted((r["doc_id"], r["kept"]) for r in quality_rules.with_verdict(measured, "lang", "source", most).collect()) for most in (0, 10**6)]
    assert both[0] == both[1]


# ---- urls


def brute_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")


def test_url_rules_match_brute_force(spark):
    r = random.Random(7)
    rules = url_rules.RULES + [("example.org", "/", "block"), ("a.example.org", "/es/x", "allow"), ("example.org", "/es/xy", "allow"), ("com", "", "block")]
    hosts = ["example.org", "a.example.org", "b.a.EXAMPLE.org", "org", "com", "x.com", "example.net", "notexample.org", ""]
    urls = [f"http://{r.choice(hosts)}{r.choice(['', '/', '/es', '/es/', '/es/x', '/es/xyz', '/en/1', '/en/12', '/en/2', '/fr/q', '/de/'])}{r.choice(['', '?q=/de/', '#x'])}" for _ in range(400)]
    urls += [None, "", "no scheme/es/", "://", "a://b://c/d"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, Rule string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for salt in (1, 1024):
        got = {x["page_id"]: (x["host"] or "", x["path"] or "", x["rule"], x["verdict"]) for x in url_rules.judge_urls(df, table, rows_per_salt=salt).collect()}
        assert got == {i: brute_verdict(u, rules) for i, u in enumerate(urls)}
    assert {x["verdict"] for x in url_rules.judge_urls(df, table.limit(0)).collect()} == {"allow"}
    clash = df.withColumn("_best", F.lit(1)).withColumn("_url", F.lit(2)).withColumn("_page", F.lit(3)).withColumn("suffix", F.lit(4))
    got = {x["page_id"]: x["verdict"] for x in url_rules.judge_urls(clash, table, max_marks=0).collect()}  # by shuffles only
    assert got == {i: brute_verdict(u, rules)[3] for i, u in enumerate(urls)}


def test_hot_suffixes_are_dealt_by_suffix_and_salt(spark):
    marks = url_rules._markers(spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string"))
    keyed = spark.range(5000).selectExpr("'org.' AS suffix", "concat('http://x.org/', id) AS url", "concat('/', id) AS key")
    swept = url_rules.sweep(keyed, marks, spark.createDataFrame([("org.", 50)], "suffix string, salts int"))
    plan = swept._jdf.queryExecution().executedPlan().toString()
    last = plan[plan.index("Window") :]
    assert re.search(r"Exchange hashpartitioning\(suffix#\d+, salt#\d+", last[: last.index("Union")])
    assert swept.count() == 5000


# ---- decontamination


def test_decontamination_finds_reparameterised_items(spark):
    item = "A train leaves Paris at 9 with 120 people and Anna counts 45 of them before the train stops for 10 minutes in Lyon"
    other = "the quick brown fox jumps over the lazy dog while nine birds sing in the old oak tree near home"
    changed = item.replace("9", "7").replace("120", "300").replace("45", "88").replace("Anna", "Maria").replace("Paris", "Rome")
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "too short"), (5, other)], "item_id long, text string")
    noise = " ".join(f"n{chr(97 + i % 26)}o" for i in range(40))
    texts = [f"{noise}. {item}. {noise}", f"{noise}. {changed}. {noise}", noise, f"x {other}", None, "", "A train leaves 9 and 120", " ".join(f"<{w}>" for w in other.split())]
    d = docs(spark, texts + texts[:1])
    want = {(0, 1, False), (1, 1, True), (3, 2, False), (3, 5, False), (7, 2, False), (7, 5, False), (8, 1, False)}
    for bound in (decontaminate.MAX_WINDOWS, 0):  # broadcast, and by a shuffle
        got = {(r["doc_id"], r["item_id"], r["reparameterised"]) for r in decontaminate.find_leaks(d, bench, bound).collect()}
        assert got == want
        assert {r["doc_id"] for r in decontaminate.drop_contaminated(d, bench, bound).collect()} == {2, 4, 5, 6}


def brute_leaks(text, items):
    """(item, consistent windows, differs) by comparing every window with every window."""
    out = set()
    keys, slot, tokens, plain = (list(x) for x in decontaminate.canonical(text or ""))
    for item_id, item in items:
        ikeys, islot, itokens, iplain = (list(x) for x in decontaminate.canonical(item or ""))
        size = min(decontaminate.WINDOW, len(ikeys))
        literal = lambda s: len(s) - sum(s) >= min(decontaminate.MIN_LITERAL, size)
        own = [o for o in range(len(ikeys) - size + 1) if size and literal(islot[o : o + size])]
        if not own:
            if len(iplain) >= decontaminate.MIN_EXACT and any(plain[p : p + len(iplain)] == iplain for p in range(len(plain))):
                out.add((item_id, 1, False))
            continue
        hits = [(o, p) for o in own for p in range(len(keys) - size + 1) if ikeys[o : o + size] == keys[p : p + size]]
        votes = {}
        for o, p in hits:
            for j in range(size):
                if islot[o + j]:
                    votes.setdefault(itokens[o + j].lower(), []).append(tokens[p + j].lower())
        bound = {k: max(set(v), key=lambda x: (v.count(x), x == k, x)) for k, v in votes.items()}
        good = {o for o, p in hits if all(bound[itokens[o + j].lower()] == tokens[p + j].lower() for j in range(size) if islot[o + j])}
        if good and len(good) >= min(decontaminate.MIN_WINDOWS, len(own)):
            out.add((item_id, len(good), any(k != v for k, v in bound.items())))
    return out


def test_decontamination_matches_brute_force_at_both_bounds(spark):
    r = random.Random(12)
    words = ["the", "train", "left", "with", "Anna", "Paris", "12", "7", "km", "people", "and", ".", "\u043f\u043e\u0435\u0437\u0434", "\u0443\u0448\u0451\u043b"]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(f"i{i}", make(r.randint(1, 14))) for i in range(12)] + [("few", "What is 12 times 13?"), ("names", "Did Anna Smith meet John Brown in Paris in 1999?"), ("tiny", "12 13"), ("null", None), ("i0", "same id, another text here for both of us")]
    items += items[:2]
    texts = [" ".join([make(6), r.choice(items)[1] or "", make(6)]) for _ in range(40)] + ["so What is 12 times 13? yes", "What is 12 times 14?", "ok. Did Anna Smith meet John Brown in Paris in 1999? no", None, ""]
    texts += texts[:3]
    d = docs(spark, texts).withColumn("doc_id", F.col("doc_id") % 5).withColumn("_row", F.lit(1)).withColumn("_doc", F.lit(2))
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = sorted((i % 5, *m) for i, t in enumerate(texts) for m in brute_leaks(t, list(dict.fromkeys(items))))
    clean = sorted(i % 5 for i, t in enumerate(texts) if not brute_leaks(t, items))
    for bound in (decontaminate.MAX_WINDOWS, 0):
        got = sorted((x["doc_id"], x["item_id"], x["n_windows"], x["reparameterised"]) for x in decontaminate.find_leaks(d, bench, bound).collect())
        assert got == want
        kept = decontaminate.drop_contaminated(d, bench, bound)
        assert sorted(x["doc_id"] for x in kept.collect()) == clean and kept.columns == d.columns
    cyrillic = spark.createDataFrame([("c", " ".join(["\u043f\u043e\u0435\u0437\u0434"] * 1000))], "item_id string, text string")
    assert decontaminate._share(cyrillic, 999) is None and decontaminate._share(cyrillic, 1000) is not None


def test_slots_must_be_consistent():
    binds = [[("9", "7")], [("9", "7")], [("9", "5")]]
    assert decontaminate.judged(1, 3, [0, 1, 2], binds) == (1, 2, 3, True)
    assert decontaminate.judged(1, 9, [0, 1], [[("9", "7")], [("9", "5")]]) is None


# ---- byte pairs


def test_bpe_matches_tiktoken(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    codec = byte_bpe.Codec(ranks)
    assert all(codec.whole.get(t) == r for t, r in ranks.items()) and codec.whole.get(b"\x00nothing\x00") is None
    assert len(codec.whole.keys) == len(ranks)  # minimal
    ours = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    alphabet = "ab  \n\t'stre vllm\x1c\x1d\x1f\x85\xa0\xb2\xbd\xaa\xb5\xe9\xdf\xf7\xd7\u4e2d\u6587\u0661\u200b\u2028\u3000\u1680\u180e\U0001f600-_%#09AZ\x00\ufeff\ufb01\u0301"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(2000)] + ["x" * 3000, " " * 500 + "a", "the end's"]
    for t in texts:
        ids = np.frombuffer(codec.encode(t), dtype="<u4").tolist()
        assert ids == ours.encode_ordinary(t), repr(t)
        assert codec.decode(codec.encode(t)) == t.encode()
    d = docs(spark, texts[:200] + [None])
    back = byte_bpe.decode(byte_bpe.encode(d, path), path, to="again").collect()
    assert all(x["again"] == (x["text"] or "") for x in back)
    digests = {x["doc_id"]: x for x in byte_bpe.round_trip(d, path).collect()}
    for i, t in enumerate(texts[:200]):
        assert digests[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert digests[i]["ids_sha256"] == hashlib.sha256(np.array(ours.encode_ordinary(t), dtype="<u4").tobytes()).hexdigest()


def test_bpe_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO", 50)
    codec = byte_bpe.Codec(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    text = " ".join(f"w{i}" for i in range(500))
    first = codec.encode(text)
    assert first == codec.encode(text) and len(codec) + len(codec.old) <= 52


# ---- html

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header>Top</header><nav><ul><li>One</li></ul></nav>
<div class="cookie-notice">We use cookies</div>{main}<aside>Side</aside><form>Name <input name=q></form><footer>&copy; end</footer></body></html>"""


def test_html_blocks_and_regions(spark):
    body = "<h1>Title &amp; more</h1><p><b>First  \n line<br>goes on<br><p>Second&nbsp;x</p><div class='ad'>Buy</div><section class=\"comments\"><p>Nice!</p></section><ul><li>a<li>b</ul>"
    page = PAGE.format(main=f"<article>{body}</article>")
    want = "Title & more\nFirst line goes on\nSecond x\na\nb"
    assert html_text.main_text(page, None) == want
    plain = PAGE.format(main="<div id=content><h2>Head</h2><p>Long text here that varies {}</p><p>And more of it</p></div>")
    rows = [(0, "http://a.com/1", page), (1, None, None), (2, "http://b.com/x", plain.format(1)), (3, "http://b.com/y", plain.format(2)), (4, "x", ""), (0, "http://a.com/1", page), (5, "http://c.com", page[: page.index("</article>")])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.extract(df).collect()}
    assert got[0]["text"] == want and got[5]["text"] == want and got[1]["text"] == "" and got[4]["n_chars"] == 0
    assert got[2]["text"] == "Head\nLong text here that varies 1\nAnd more of it"
    assert html_text.extract(df).count() == len(rows) and html_text.extract(df.limit(0)).count() == 0
    found = {r["host"]: r for r in html_text.infer_wrappers(html_text.measure(df)).collect()}
    assert "html/body/div.content/p{}+" in found["b.com"]["pattern"] and found["b.com"]["region"] == "html/body/div.content"


def test_alignment_resolves_optional_and_repeated_groups():
    item = lambda n, h=0: [[n], False, False, 1, 5, False, h]
    a = html_text.collapse([item("h"), item("p"), item("q"), item("p"), item("q"), item("f", 1)])
    assert html_text.pattern(a) == "h (p q)+ f"
    b = html_text.collapse([item("h"), item("x"), item("f", 2)])
    assert html_text.pattern(html_text.align(a, b)) == "h (p q)+? x? f{}"


def test_wrapper_tree_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(html_text, "GROUP", 4)
    pages = [(i, "http://a.com", "<article>" + "".join(f"<{t}>x{i}</{t}>" for t in t_) + "</article>") for i, t_ in enumerate([["p"], ["h1", "p"], ["ul", "p"], ["h2"], ["dl", "p"], ["pre"], ["h3", "p"], ["h4"], ["table"]])]
    found = html_text.infer_wrappers(html_text.measure(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()
    assert len(found) == 1 and found[0]["region"] == "//article"


def host_pages(article=True, n=12):
    """Pages of one host whose notice and service line carry no telling markup; and the main text of each."""
    r = random.Random(3)
    words = [f"word{i}" for i in range(400)]
    sentence = lambda k: " ".join(r.choices(words, k=k)).capitalize() + "."
    rows, want = [], []
    for i in range(n):
        head, parts = sentence(5), [sentence(r.randint(20, 60)) for _ in range(r.randint(2, 4))]
        body = f"<h1>{head}</h1><p>Subscribers read this page first, so please log in.</p>" + "".join(f"<p>{x}</p>" for x in parts) + '<section class="related-work"><p>' + (more := sentence(9)) + '</p></section><p class="header-lead">' + (lead := sentence(7)) + "</p>"
        inner = f"<article>{body}</article>" if article else f'<div class="post">{body}</div>'
        rows.append((i, f"http://h.example.org/{i}", f"<html><body><div><a href=/>Start</a> <a href=/x>More of it</a></div>{inner}<div>Call our service line at any time of day</div><div class='ad-box'>{sentence(30)}</div></body></html>"))
        want.append("\n".join([head, *parts, more, lead]))
    return rows, want


def test_wrappers_choose_the_text_with_and_without_article_markup(spark):
    schema = "page_id long, url string, html string"
    for article in (True, False):
        rows, want = host_pages(article)
        got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, schema)).collect()}
        assert [got[i] for i, *_ in rows] == want
        # Without the host's wrapper the notice stays.
        assert all(html_text.main_text(page, None) != text and "Subscribers" in html_text.main_text(page, None) for (_, _, page), text in zip(rows, want))
    copies, want = host_pages(n=1)  # copies of one article don't make its text template
    df = spark.createDataFrame([(i, copies[0][1], copies[0][2].replace("ad-box'>", f"ad-box'>{i}")) for i in range(20)], schema)
    text = {r["text"] for r in html_text.extract(df).collect()}
    assert len(text) == 1 and want[0].split("\n")[1] in text.pop()


def test_html_matches_a_plain_computation(spark):
    """Regions and templates from all pages of a host in one process."""
    rows = [(i, u, h) for k, article in enumerate((True, False)) for i, u, h in [(100 * k + i, u.replace("h.", f"h{k}."), h) for i, u, h in host_pages(article)[0]]]
    rows += [(r["page_id"] + 1000, r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    rows += [(2000, None, "<p>alone</p>"), (2001, "http://h0.example.org/z", None)]
    hosts, want = {}, {}
    for i, u, h in rows:
        hosts.setdefault(brute_verdict(u, [])[0], []).append((i, h or ""))
    for pages in hosts.values():
        parsed = [[b for b in html_text.blocks(h) if not b.dropped] for _, h in pages]
        longest = [max(p, key=lambda b: len(b.text)) if p else None for p in parsed]
        where = {}
        for p, main in zip(parsed, longest):
            for b in p:
                where.setdefault((b.path, b.text), set()).add((main.path, main.text))
        total = len({(m.path, m.text) for m in longest if m})
        template = {k for k, v in where.items() if len(v) >= html_text.PAGES and len(v) >= (html_text.MARKED if html_text.marked(k[0]) else html_text.SHARE) * total}
        got = None
        for w in sorted((html_text.stream(html_text.blocks(h)) for _, h in pages), key=str):
            got = w if got is None else html_text.align(got, w)
        region = html_text.region(got)
        for (i, h), p in zip(pages, parsed):
            live = [b for b in p if (b.path, b.text) not in template]
            kept = [b.text for b in live if html_text.inside(b.path, region)] or [b.text for b in live if html_text.inside(b.path, html_text.region(html_text.stream(live)))]
            want[i] = "\n".join(kept)
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_broken_markup():
    text = lambda h: html_text.main_text(h, None)
    assert text('<p><a title="x>world</a> goes <b class="y">on</b></p>') == "world goes on"
    assert text('<p title="a > b" data-x=\'<i>\'>one</p><p class=ad-slot>two</p>') == "one"
    deep = "<div>" * 5000
    assert text(f"<aside>{deep}gone</aside>{deep}stays") == "stays"
    assert len(html_text.blocks("<a title=\"x>w</a>" * 20000)) == 1
