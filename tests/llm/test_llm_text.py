"""Quality rules, personal data, URL filter and quality scores."""
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import pii, quality_knn, quality_rules as Q, url_filter as U

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(t):
    t = t or ""
    w = WORD.findall(t)
    win = {}
    for i in range(len(w) - 4):
        win.setdefault(tuple(w[i:i + 5]), []).append(i)
    rep = {i + k for at in win.values() if len(at) > 1 for i in at for k in range(5)}
    lines, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)


def texts():
    rng = random.Random(4)
    al = ["a", "b", "c", " ", " ", "\n", "\t", "|", "!!", ".", "é", "\u00a0", "#", "the end.\n", "\U0001F600"]
    return [None, "", "\n\n", "\u00a0", "\u00a0\n\u00a0", "x " * 50_000, "a b c d e a b c d e"] + ["".join(rng.choices(al, k=rng.randrange(80))) for _ in range(3000)]


def test_quality_base(spark):
    t = texts()
    d = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    out = {r.doc_id: r for r in Q.quality_rules(d).collect()}
    for i, x in enumerate(t):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(x), repr(x)
        assert not (r.kept and r.base_failed)
    assert Q.quality_rules(d.where("false")).collect() == []


def test_lines_are_removed_first():
    good = "This is a line of plain words that ends well. It has another sentence, too."
    other = "Here stands one more sentence, with none of the words from above."
    nav = "Home | News | Sports | Contact | About | Help"
    r = dict(zip([x.split()[0] for x in Q.SCHEMA.split(", ")], Q.judge(f"{good}\n{nav}\n\n{other}\nAll rights reserved.", Q.Rules())))
    assert r["kept"] and r["clean_text"] == f"{good}\n\n{other}" and r["lost_lines"] == 2
    assert not Q.judge("\n".join([nav] * 5) + "\n" + nav.replace("|", "»"), Q.Rules())[6]
    assert not Q.judge("BUY!! NOW!! THIS!! IS!! THE!! BEST!! OFFER!! EVER!! MADE!! TODAY!! HERE!!", Q.Rules())[6]
    assert Q.judge(good, Q.Rules())[6]


def test_quality_rules_agree_with_labels(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.quality_rules(docs).join(labels, "doc_id").select("quality", "base_failed", "kept").collect()
    assert all(r.kept for r in rows if r.quality == 1 and not r.base_failed)
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.05


SCRIPTS = {
    "hi": "यह एक साधारण वाक्य है जो गाँव के पुराने बाज़ार के बारे में बताता है।\nलोग हर सुबह वहाँ ताज़ी सब्ज़ियाँ और फल खरीदने आते हैं।",
    "ur": "یہ ایک سادہ جملہ ہے جو گاؤں کے پرانے بازار کے بارے میں بتاتا ہے۔\nلوگ ہر صبح وہاں تازہ سبزیاں خریدنے آتے ہیں۔",
    "ar": "هل رأيت السوق القديم في القرية حيث يأتي الناس كل صباح؟\nنعم، رأيته أمس مع صديقي وكان مليئا بالناس والبضائع الجديدة؟",
    "hy": "Սա մի պարզ նախադասություն է, որը պատմում է գյուղի հին շուկայի մասին։\nՄարդիկ ամեն առավոտ գալիս են այնտեղ թարմ միրգ գնելու։",
    "am": "ይህ ስለ መንደሩ አሮጌ ገበያ የሚናገር ቀላል ዓረፍተ ነገር ነው።\nሰዎች በየጠዋቱ ትኩስ አትክልትና ፍራፍሬ ለመግዛት ወደዚያ ይመጣሉ።",
    "my": "ဤ ဝါကျ သည် ရွာ ဈေး အကြောင်း ပြော သော ရိုးရှင်း သော ဝါကျ ဖြစ် သည်။\nလူ များ နေ့ တိုင်း ထို နေရာ သို့ လာ ကြ သည်။",
    "zh": "这 是 一 个 关于 村里 老 市场 的 简单 句子。人们 每天 早上 都 来 这里\n他们 买 新鲜 的 蔬菜 和 水果。”",
    "th": "นี่คือ ประโยค ง่าย ๆ ที่ เล่า เกี่ยวกับ ตลาด เก่า ใน หมู่บ้าน\nผู้คน มา ที่นั่น ทุก เช้า เพื่อ ซื้อ ผัก สด",
    "el": "Είδες την παλιά αγορά του χωριού όπου έρχονται όλοι κάθε πρωί;\nΝαι, την είδα χθες μαζί με τον φίλο μου.",
    "fr": "« Bonjour », dit-elle en entrant, « vous êtes donc venu seul ce matin au marché du village ? »\n« Oui. »",
    "en": "These are the things that the old market in the village sells every morning:\nfresh bread, new cheese, and red apples from the hills nearby;",
}


@pytest.mark.parametrize("lang", SCRIPTS)
def test_sound_texts_of_any_script_stay(lang):
    r = Q.judge(SCRIPTS[lang], Q.Rules())
    assert r[6] and r[-1] == SCRIPTS[lang], lang
    bare = "".join(" " if c in "।۔؟։።။。.:;”" else c for c in SCRIPTS[lang])
    assert lang in ("th", "fr") or not Q.judge(bare, Q.Rules())[6]


def verdict(t):
    """What the rules say of a text, spelled out word by word. ``(kept, words lost, text left)``."""
    def ends(line):
        for i, c in enumerate(line):
            if c in Q.WIDE_ENDS:
                return True
            if c in Q.ENDS:
                rest = line[i + 1:].lstrip(Q.CLOSERS)
                if rest == "" or rest[0] in " \t\r\xa0":
                    return True
        return False

    def noisy(w):
        run = any(w[i] in "#*$%&|<>~^=_" and w[i + 1] in "#*$%&|<>~^=_" for i in range(len(w) - 1))
        return run or len(w) > 1 and w[-1] in "!?" and w[-2] in "!?" or all(c in "|#*$%&<>~^=_" for c in w)

    def fails(line):
        w = line.split()
        low, held = " " + " ".join(w).lower() + " ", 0
        if len(w) <= 20:
            at = 0
            while at < len(low):
                hit = next((p for p in Q.BOILERPLATE if low.startswith(p, at) and not (low[at - 1].isalnum() or low[at - 1] == "_")
                            and not (low[at + len(p)].isalnum() or low[at + len(p)] == "_")), None)
                held += len(hit.split()) if hit else 0
                at += len(hit) if hit else 1
            if held and 3 * held >= 2 * len(w):
                return True
        marks, i, whole = 0, 0, line
        line = line.replace("»", "") if "«" in line else line
        while i < len(line):  # a mark stands at the start or behind a blank, with blanks and then anything or the end behind it
            if line[i] in "|›»·•>/" and (i == 0 or line[i - 1] in " \t"):
                j = i + 1
                while j < len(line) and line[j] in " \t":
                    j += 1
                if j == len(line) or not line[j].isspace():
                    marks += 1
            i += 1
        if marks >= 2 and 6 * marks >= len(w) or marks and len(w) < 6:
            return True
        line = whole
        if not ends(line) and 3 * sum("\u0e01" <= c <= "\u0e2e" or "\u0e81" <= c <= "\u0eae" or "\u1780" <= c <= "\u17b3" for c in line) < sum(map(len, w)):
            return True
        return sum(map(noisy, w)) > 0.3 * len(w)

    lines = (t or "").split("\n")
    bad = [bool(x.split()) and fails(x) for x in lines]
    lost, all_words = sum(len(x.split()) for x, b in zip(lines, bad) if b), sum(len(x.split()) for x in lines)
    kept = not base_counts(t)[5] and all_words > 0 and lost <= 0.35 * all_words
    return kept, lost, "\n".join(x for x, b in zip(lines, bad) if not b)


def test_verdicts_equal_brute_force(spark, sf):
    rng = random.Random(9)
    al = ["a good line of words ends here.", "home", "|", "»", "all rights reserved", "Privacy Policy", "BUY!!", "##", "x", "\n", "\n", "the end", ". ", "?", "ตลาด", "。", "»)", "word", "two words;", "powered by", "_", "/", "•", "«", "other words stand in this line, which is long enough."]
    t = [" ".join(rng.choices(al, k=rng.randrange(30))) for _ in range(3000)] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for x in t:
        r = Q.judge(x, Q.Rules())
        assert (r[6], r[7], r[-1]) == verdict(x), repr(x)


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    out = []
    for k, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}", kind))
    out.sort()
    return ",".join(x[2] for x in out), [sum(x[3] == k for x in out) for k in RULES]


def test_pii_base_equals_brute_force(spark):
    rng = random.Random(3)
    al = list("ab1234567890") + ["@", "@", ".", ".", "-", " ", "+", "(", ")", "_", "%", "1.2.3.4", "a@b.c", "é", "\U0001F600", "+1 ", "4111 1111 1111 1111", "\n", "300.1.2.3"]
    t = ["".join(rng.choices(al, k=rng.randrange(40))) for _ in range(4000)]
    t += [None, "", "1" * 100_000, "a" * 100_000, "a@b.c " * 100_000, "1 " * 50_000, "a." * 50_000 + "@", "+1 (012) 555-1234 " * 50_000, "212 555 0199, x 1.2.3.4 é a12345 " * 20_000]
    d = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").withColumn("h", F.lit(0)).withColumn("email", F.lit("clash")).repartition(4)
    for r in pii.find_pii(d).collect():
        assert (r.base_spans, [r.n_email, r.n_ip, r.n_card, r.n_phone]) == base_spans(t[r.doc_id]), repr(t[r.doc_id])[:200]


def test_pii_patterns_discover_the_unseen(spark):
    known = [(i, f"Some words {i}. Call me at +1 (212) 555-{1000 + i} tomorrow, item {10000 + i} is ready.") for i in range(30)]
    unseen = [(100, "Please call me at 2125550199 soon"), (101, "The item 2125550188 is ready"), (102, None), (102, None), (None, "call me at 2125550177.")]
    out = pii.find_pii(spark.createDataFrame(known + unseen, "doc_id long, text string")).collect()
    found = {r.doc_id: r.spans for r in out if r.spans != r.base_spans}
    assert found == {100: "phone:18:28", None: "phone:11:21"}
    assert len(out) == len(known + unseen)
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).collect() == []


URLS = [None, "", "http://", "no scheme casino", "://", "HTTP://A.Org/x", "http://example.org/es/1", "http://sub.example.org/en/12", "http://xexample.org/en/1", "http://a.com/fr/x", "http://com/de/",
        "http://a.net/free-bets", "http://a.net/freebets", "http://a.net/free/free", "http://casino.net", "http://casinos.net", "http://my-Casino.net?x", "a://b://c?d", "http://é.net/free bets", "http://a.net#casino",
        "http://a.net/x\ncasino", "http://a.net/" + "free/" * 20_000]


def test_url_filter_equals_sql(spark):
    import duckdb
    d = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = sorted((tuple(r) for r in U.url_filter(d).select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(URLS)))
    assert got == sorted(con.execute(U.sql()).fetchall(), key=repr)
    verdict = {URLS[r[0]]: r[4] for r in got}
    assert verdict["http://a.net/free-bets"] == verdict["http://casino.net"] == verdict["http://sub.example.org/en/12"] == "block"
    assert verdict["http://a.net/free/free"] == verdict["http://casinos.net"] == verdict["http://a.net/freebets"] == verdict[None] == "allow"


def test_scores_on_held_out_rows(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_knn.train(docs, labels)
    rows = quality_knn.scored(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    x = np.stack([quality_knn.term_counts(t, quality_knn.Terms()) for t in ("a word", "", "###")])
    cos = model.embed(x) @ model.vectors.T
    for c, s in zip(cos, model.score(x)):
        near = np.argsort(-c)[:model.k]
        w = np.maximum(c[near], 0.0).astype(float) ** model.power * model.weight[near]
        assert s == pytest.approx((w * model.labels[near]).sum() / w.sum() if w.sum() > 1e-12 else model.prior, abs=1e-6)


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 100_000), (4, "w" * 300_000), (None, "x"), (5, "same"), (5, "same")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (4, None, 0), (5, 0, 0), (None, 1, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.where("false")):
        out = quality_knn.scored(docs, quality_knn.train(docs, lab)).collect()
        assert len(out) == 7 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert quality_knn.scored(docs.where("false"), None).collect() == []


def test_boilerplate_counts_as_lost():
    names = [x.split()[0] for x in Q.SCHEMA.split(", ")]
    judged = lambda t: dict(zip(names, Q.judge(t, Q.Rules())))
    good = "Here stands one sentence of plain words that ends well, with no phrase in it at all."
    notes = "\n".join(f"All rights reserved {i}." for i in range(70))
    r = judged(f"{notes}\n{good}")
    assert not r["kept"] and not r["base_failed"] and r["lost_words"] == 70 * 4 and r["clean_text"] == good
    long = " ".join(f"word{i}" for i in range(300)) + " and the mill, powered by water, has a privacy policy."
    for t in (long, f"{good}\n{long}", good + " It was licensed under a rule of the town, which the mayor had read aloud twice."):
        assert judged(t)["kept"] and judged(t)["clean_text"] == t and judged(t)["lost_words"] == 0
    for line in ("All rights reserved.", "Licensed under MIT", "Powered by WordPress", "Privacy Policy | Terms of Use", "Copyright © 2001 Company. All rights reserved."):
        assert Q.line_fault(line, line.split(), Q.Rules()) == "boilerplate", line
    assert Q.line_fault("Empowered by hope.", ["Empowered", "by", "hope."], Q.Rules()) is None


def test_pii_discovers_identifiers_with_blanks(spark):
    known = [(i, f"Some words {i}. Call me at +1 (212) 555-{1000 + i} until noon, please.") for i in range(30)]
    known += [(50 + i, f"Charge card no. {c} today.") for i, c in enumerate(("4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009", "3000 0000 0000 04", "6011 0000 0000 0004"))]
    known += [(60 + i, f"Write mail to user{i}@mail.org now.") for i in range(9)]
    new = {100: ("call me at (212) 555 0199", "(212) 555 0199", "phone"), 101: ("Then call me at 212 555 0199, or not", "212 555 0199", "phone"),
           102: ("The card no. 4111 1111 1111 111x is gone", "4111 1111 1111 111x", "card"), 103: ("Another card no. 4111 1111 1111 1112.", "4111 1111 1111 1112", "card"),
           104: ("Dial 212 555 0177 until noon, she said", "212 555 0177", "phone"), 105: ("So call me at 2125550199 42 times", "2125550199", "phone"),
           106: ("You call me at 212-555-0199 42 times", "212-555-0199", "phone"), 107: ("Write mail to jo [at] mail.org now", "jo [at] mail.org", "email"),
           108: ("Write mail to " + "j" * 300 + "@localhost now", "j" * 300 + "@localhost", "email")}
    none = [(200, "Rows 12 34 56 78 90 stand here"), (201, "at 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2"), (202, "at " + "1 " * 50_000)]
    d = spark.createDataFrame(known + [(i, t[0]) for i, t in new.items()] + none, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_pii(d).collect() if r.spans != r.base_spans}
    assert got == {i: f"{k}:{t.index(m)}:{t.index(m) + len(m)}" for i, (t, m, k) in new.items()}
