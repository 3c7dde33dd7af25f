from __future__ import annotations

import math
import random
from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.compare import same
from tests.llm import plain_pii
from tidemark.llm import pii, quality, urlfilter


def rewritten(spark, texts, **more):
    found = pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), **more).collect()
    return [(r["text"], r["pii_kinds"]) for r in sorted(found, key=lambda r: r["doc_id"])]


def luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_formats_are_kept_and_values_linked(spark):
    texts = ["card 4111 1111 1111 1111.", "4111-1111-1111-1111", "4111111111111111 and 4111111111111112", "SSN 123-45-6789", "IBAN GB82 WEST 1234 5698 7654 32", "on 2021-02-28 or 28/02/2021", "ip 192.168.1.10", "Mail Joe.Doe12@mail3.example.com!", "joe.doe12@mail3.example.com", "+1 (555) 123-4567 555-123-4567", 'TOKEN = "24BE64439E3E49CF46B2D7C90F3602A3D0B907FF"', "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "000-12-3456 2021-02-30 999.1.1.1 DE89370400440532013001 12345", None, "", "no data here"]
    out = rewritten(spark, texts)
    digits = ["".join(c for c in t or "" if c.isdigit()) for t, _ in out]
    assert digits[0] == digits[1] == digits[2][:16] != "4111111111111111" and luhn(digits[0]) and not luhn(digits[2][16:])
    assert out[0][0][9] == " " and out[1][0][4] == "-" and out[0][1] == ["card"] and out[2][1] == ["card"] and out[2][0].endswith(" and 4111111111111112")
    assert out[3][1] == ["ssn"] and out[3][0] != texts[3]
    country = out[4][0][5:].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in country[4:] + country[:4])) % 97 == 1 and country[:2] == "GB" and out[4][0][5:9] != "GB82"
    assert out[5][1] == ["date", "date"] and pd.Timestamp(out[5][0][3:13]) == pd.to_datetime(out[5][0][17:], format="%d/%m/%Y") != pd.Timestamp("2021-02-28")
    assert out[6][1] == ["ip"] and out[6][0] != texts[6] and all(0 <= int(x) < 256 for x in out[6][0][3:].split("."))
    assert out[7][0].lower() == f"mail {out[8][0]}!" and out[8][0].endswith("@mail3.example.com") and out[8][0] != texts[8] and out[7][0][5].isupper()
    assert digits[9][0] == "1" and digits[9][1:11] == digits[9][11:] != "5551234567"
    assert out[10][0] == f'TOKEN = "{out[11][0].upper()}"' and out[11][0] != texts[11] and int(out[11][0], 16)
    assert [o for o, _ in out[12:]] == texts[12:] and not any(k for _, k in out[12:])
    phones = ["+1(555)1234567 now", "(555)123-4567", "+44 20 7946 0958", "+15551234567", "+9 (999) 999-9999 10.20.30.40", "5551234567 1-2-3"]
    called = rewritten(spark, phones)
    assert [k for _, k in called] == [["phone"], ["phone"], ["phone"], ["phone"], ["phone", "ip"], []] and called[5][0] == phones[5]
    assert called[0][0][3:6] + called[0][0][7:14] == called[1][0].translate({ord(c): None for c in "()-"}) == called[3][0][2:] != "5551234567"
    assert rewritten(spark, texts) == out and rewritten(spark, texts[:1], key="another")[0][0] != out[0][0]


def test_cards_need_their_check_digit(spark):
    texts = ["4111111111111112", "4111 1111 1111 1112", "at 1700000000123 ISBN 9783161484100", "4111111111111111 or 4111111111111112", "378282246310005"]
    out = rewritten(spark, texts)
    assert out[:3] == [(t, []) for t in texts[:3]]
    assert out[3][1] == ["card"] and out[3][0].endswith(" or 4111111111111112") and luhn(out[3][0][:16]) and not out[3][0].startswith("4111111111111111")
    assert out[4][1] == ["card"] and luhn(out[4][0]) and out[4][0] != texts[4]


def test_values_at_the_bounds_of_patterns(spark):
    run = "0123456789abcdef" * 9
    ibans = ["ES91 2100 0418 4502 0005 1332 BIC CAIXESBB", "AT61 1904 3002 3457 3201 BIC 4111 1111 1111 1111", "ES9121000418450200051332 1234"]
    dates = ["12/25/2024", "1.2.2024", "01.02.2024", "2024/12/25", "25-12-2024", "2024-2-1", "12-25-2024"]
    out = rewritten(spark, [run, run.upper(), run[:20].upper() + run[20:40], *ibans, *dates, "13/13/2024 30.2.2024 x.org/2024/12/25/ 3.1.2.2024"])
    assert [k for _, k in out[:3]] == [["secret"]] * 3 and all(int(t, 16) and len(t) == n for (t, _), n in zip(out, (144, 144, 40)))
    assert out[0][0] != run and out[1][0] == out[0][0].upper() and out[2][0] != out[2][0].upper() and out[2][0] != out[2][0].lower()
    assert out[3][1] == ["iban"] and out[3][0].endswith(" BIC CAIXESBB") and out[4][1] == ["iban", "card"] and out[5][1] == ["iban"] and out[5][0].endswith(" 1234")
    assert out[3][0][:29].replace(" ", "") == out[5][0][:24] != "ES9121000418450200051332"
    found = dict(zip(dates, out[6:13]))
    assert all(k == ["date"] and t != d for d, (t, k) in found.items())
    christmas = [pd.to_datetime(found[d][0], format=f) for d, f in (("2024/12/25", "%Y/%m/%d"), ("25-12-2024", "%d-%m-%Y"))]
    second = [pd.to_datetime(found[d][0], format=f) for d, f in (("1.2.2024", "%d.%m.%Y"), ("01.02.2024", "%d.%m.%Y"), ("2024-2-1", "%Y-%m-%d"))]
    american = [pd.to_datetime(found[d][0], format=f) for d, f in (("12/25/2024", "%m/%d/%Y"), ("12-25-2024", "%m-%d-%Y"))]
    assert len({*christmas, *american}) == len(set(second)) == 1 and american[0].day > 12 >= second[0].day
    assert out[13][1] == []
    days = spark.range(73049).select(F.date_add(F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int")).alias("d")).where("day(d) > 12 and id % 20 = 0")
    moved = days.select(pii.date(F.date_format("d", "MM/dd/yyyy"), "k").alias("x"))
    assert moved.where("substr(x, 4, 2) > '12'").distinct().count() == days.count()


QUOTED = ["ID12 4111 1111 1111 1111", "GB12 4111 1111 1111 1111 12", "BE12 4111 1111 1111 1111", "3782 822463 10005", "12/25/2020", "order 1234567890123", "+1 20 300 400"]


def test_values_inside_what_is_not_valid(spark):
    out = dict(zip(QUOTED, rewritten(spark, QUOTED)))
    assert [out[t][1] for t in QUOTED] == [["card"], ["card"], ["card"], ["card"], ["date"], [], ["phone"]]
    assert out[QUOTED[0]][0].startswith("ID12 ") and luhn(out[QUOTED[0]][0][5:]) and out[QUOTED[0]][0] != QUOTED[0]
    assert out["3782 822463 10005"][0][4] == out["3782 822463 10005"][0][11] == " " and luhn(out["3782 822463 10005"][0])
    assert out["+1 20 300 400"][0].startswith("+1 ") and out["order 1234567890123"][0] == "order 1234567890123"


def test_pseudonyms_by_plain_python(spark, sf_dir, docs, rows):
    more = [*QUOTED, "GB82 WEST 1234 5698 7654 32 and 4111 1111 1111 1111, DE89370400440532013000 DE89370400440532013001", "x@y.org É.b+c@d-e.fr 1.2.3.4 078-05-1120", "", None, "2024-2-1 1.2.2024 12/25/2024 31.02.2024"]
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + more
    for text, got in zip(texts, rewritten(spark, texts), strict=True):
        assert got == plain_pii.rewritten(text)
    twice = spark.createDataFrame([(None, t, 1, "n") for t in more] * 2, "doc_id long, text string, pii_found int, `odd name` string")
    found = pii.pseudonymised(twice)
    assert found.columns == ["doc_id", "text", "odd name", "pii_kinds", "pii_found"]
    expected = [plain_pii.rewritten(t) for t in more] * 2
    assert sorted(map(repr, ((r["text"], r["pii_kinds"]) for r in found.collect()))) == sorted(map(repr, expected))


def test_networks_are_permutations(spark):
    pairs = spark.range(17 * 23).select(pii.permuted_pair(F.floor(F.col("id") / 23), F.col("id") % 23, 17, 23, "k").alias("p")).collect()
    assert {(r["p"]["x"], r["p"]["y"]) for r in pairs} == {(x, y) for x in range(17) for y in range(23)}
    values = [f"{i:03d}" for i in range(1000)]
    found = spark.createDataFrame([(v,) for v in values], "v string").select(pii.permuted(F.col("v"), "k").alias("x")).collect()
    assert sorted(r["x"] for r in found) == values
    day = F.date_add(F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int"))
    days = spark.range(73049).select(day.alias("d"), pii.date(F.date_format(day, "yyyy-MM-dd"), "k").alias("x"))
    assert days.select("x").distinct().count() == 73049 and days.where("(day(d) > 12) <> (day(date(x)) > 12)").count() == 0


def test_texts_pass_through_with_other_columns(docs, rows, no_docs):
    out = pii.pseudonymised(docs)
    assert out.columns == [*docs.columns, "pii_kinds", "pii_found"]
    assert sorted(map(repr, (r[:8] for r in map(tuple, out.collect())))) == sorted(map(repr, rows))
    assert pii.pseudonymised(no_docs).count() == 0


def plain_features(text):
    raw = (text or "").encode()
    words = raw.split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in raw.split(b"\n") if x.split()]
    joined = b"".join(words).decode()
    return len(words), len(joined), sum(c in "#*$%&|<>" for c in joined), len(lines) - len(set(lines)), len(covered)


def test_features_by_plain_count(docs, rows):
    found = quality.described(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    short = [r for r in rows if len(r[1] or "") < 8000]
    expected = sorted(repr((r[0], *plain_features(r[1]))) for r in short)
    kept = {r[0] for r in short}
    assert sorted(repr(tuple(r)) for r in found if r["doc_id"] in kept) == expected
    assert {r["doc_id"]: r["n_repeat_words"] for r in found}[rows[[x[1] for x in rows].index("word " * 3000)][0]] == 3000


def test_binomial_tail():
    for n, k, p in ((10, 3, 0.2), (400, 0, 0.01), (50, 50, 0.3), (700, 9, 0.02)):
        assert quality.binomial_tail(n, k, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_cutoffs_need_proof():
    cells = {20: (0, 50), 3: (1, 30), 0: (1999, 0)}
    assert quality.choose({("en", "symbols"): cells}, {"en": 2000}) == {("en", "symbols"): 15}  # one false for thirty right
    assert quality.choose({("en", "symbols"): cells}, {"en": 300}) == {}
    many = {20: (100, 5000), 0: (1900, 0)}
    assert quality.choose({("en", "symbols"): many}, {"en": 2000}) == {}


def test_rules_of_a_stratum_share_its_limit(spark):
    cells = {20: (8, 500), 0: (3992, 0)}
    counts = {("en", name): {min(k, len(quality.CUTOFFS[name])): v for k, v in cells.items()} for name in quality.RULES}
    chosen = quality.choose(counts, {"en": 4000})
    level = quality.DELTA / sum(map(len, quality.CUTOFFS.values()))
    assert len(chosen) == 1 and len(quality.choose(counts | {("en", "symbols"): {20: (0, 900), 0: (4000, 0)}}, {"en": 40000})) == 5
    assert sum(quality.most_rejected(4000, 8, level) for _ in chosen) <= quality.LIMIT
    assert quality.binomial_tail(4000, 8, quality.most_rejected(4000, 8, level)) == pytest.approx(level, rel=1e-6)


def plain_choose(counts, good):
    """The cutoffs by exact fractions and a scan of shares instead of bisection."""
    level = Fraction(quality.DELTA).limit_denominator(1000) / (sum(map(len, quality.CUTOFFS.values())) * len(good))

    def tail(n, k, p):
        return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    out = {}
    for where, n in good.items():
        left = Fraction(quality.LIMIT).limit_denominator(1000)
        tries = []
        for order, name in enumerate(quality.RULES):
            for i, at in enumerate(quality.CUTOFFS[name], 1):
                bad, wrong = (sum(v[side] for cell, v in counts.get((where, name), {}).items() if cell >= i) for side in (1, 0))
                tries.append((wrong * quality.WORTH - bad, order, -at, name, at, wrong))
        for loss, _, _, name, at, wrong in sorted(tries):
            if loss < 0 and (where, name) not in out and wrong < left * n and tail(n, wrong, left) <= level:
                out[where, name] = at
                share = Fraction(wrong, n)
                step = Fraction(1, 4)
                while step > Fraction(1, 1 << 22):
                    share, step = (share + step, step) if share + step < 1 and tail(n, wrong, share + step) > level else (share, step / 2)
                left -= share
    return out


def drawn(rng, good, share):
    """Cells of a holdout: every rule's values are above its first i cutoffs with the part share / i of good and 0.9 / i of bad documents."""
    counts = {}
    for name in quality.RULES:
        n = len(quality.CUTOFFS[name])
        cells = [np.minimum(n, np.floor(x / rng.random(m)).astype(int)) for m, x in ((good, share), (400, 0.9))]
        numbers = [np.bincount(c, minlength=n + 1) for c in cells]
        counts["en", name] = {i: (int(numbers[0][i]), int(numbers[1][i])) for i in range(n + 1) if numbers[0][i] + numbers[1][i]}
    return counts


def test_cutoffs_are_those_of_exact_fractions():
    rng = np.random.default_rng(2)
    found = [(quality.choose(c, {"en": 900}), plain_choose(c, {"en": 900})) for c in (drawn(rng, 900, share) for share in (0.0, 0.002, 0.004, 0.01))]
    assert all(a == b for a, b in found) and any(a for a, _ in found)


def test_cutoffs_keep_their_limit_on_fresh_documents():
    """Of many holdouts, few choose cutoffs whose true part of good documents exceeds the limit; many choose some."""
    rng = np.random.default_rng(3)
    exceeded = chosen = 0
    for _ in range(300):
        cutoffs = quality.choose(drawn(rng, 2500, 0.02), {"en": 2500})
        true = sum(0.02 / (quality.CUTOFFS[name].index(at) + 1) for (_, name), at in cutoffs.items())
        exceeded, chosen = exceeded + (true > quality.LIMIT), chosen + bool(cutoffs)
    assert exceeded <= 300 * quality.DELTA and chosen > 150


def test_any_language_is_a_stratum(spark):
    made = [(i, ("%%%" if i % 10 == 0 else "").join(f" w{i * 41 + k}" for k in range(40)), ["it", "nl"][i % 3 == 0]) for i in range(3000)]
    rows = spark.createDataFrame(made, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(3000)], "doc_id long, quality int, toxic int")
    few = labels.where("doc_id % 3 <> 0 or doc_id < 900")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(rows, few).collect()}
    assert all(kept[i] == (i % 10 != 0 or i % 3 == 0) for i in range(3000))


def test_quality_keeps_good_documents(spark, docs, rows, no_docs):
    rng = random.Random(3)
    made = [(1000 + i, ("%%%" if i % 10 == 0 else "").join(f" {rng.randrange(10**6)}" for _ in range(40)), "en", "s", 0, 0, "", "") for i in range(3000)]
    every = docs.union(spark.createDataFrame(made, docs.schema))
    labels = spark.createDataFrame([(1000 + i, int(i % 10 != 0), 0) for i in range(3000)] + [(None, 1, 0), (1001, 0, 0)], "doc_id long, quality int, toxic int")
    judged = {r["doc_id"]: r for r in quality.judge(every, labels).where("doc_id >= 1000").collect()}
    assert all(judged[1000 + i]["kept"] == (i % 10 != 0) for i in range(3000))
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns
    base = [r for r in rows if len((r[1] or "").split()) >= 10 and r[1] != "word " * 3000 and plain_features(r[1] if len(r[1]) < 8000 else "")[4] * 5 <= len(r[1].split())]
    found = kept.collect()
    assert {repr(tuple(r)) for r in found} <= {repr(r) for r in base} and len(found) >= len(base) - 1
    none = labels.limit(0)
    assert quality.keep(no_docs, labels).count() == 0 and sorted(repr(tuple(r)) for r in quality.keep(docs, none).collect()) == sorted(map(repr, base))


def test_url_verdicts_match_their_sql(spark, sf_dir):
    same(urlfilter.op4_url_filters(spark, sf_dir), urlfilter.OP4_SQL, sf_dir)


def test_url_parts_and_rules(spark, tmp_path):
    urls = ["HTTP://A.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://example.org/en/2", "http://org", "http://notorg/x", "http://x.com/fr/", "http://com/de/1", "http://x.com/DE/1", None, "", "no-scheme.org/", "http://h?a/b://c", "ftp://É.org/Ü", "http://a.net/p"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(99, "http://a.net/p", "h")], "page_id long, url string, host string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages).collect()}
    assert [found[i][:3] for i in range(len(urls))] == [
        ("a.example.org", "/es/x", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("example.org", "/en/2", "org/"), ("org", "", None), ("notorg", "/x", None), ("x.com", "/fr/", "com/fr/"), ("com", "/de/1", "com/de/"),
        ("x.com", "/DE/1", None), ("", "", None), ("", "", None), ("", "", None), ("h", "", None), ("É.org", "/Ü", "org/"), ("a.net", "/p", None),
    ]
    assert [found[i][3] for i in (0, 1, 2, 5, 6)] == ["block", "block", "allow", "allow", "block"]
    assert all(v[3] in ("allow", "block") for v in found.values()) and found[13] == found[99]
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_urls_are_told_apart_by_digits_and_however_grams_are_looked_up(spark, monkeypatch):
    bodies = [(f"a.org/{i}", 1, 0) for i in range(40, 50)] + [(f"a.org/{i}", 0, 1) for i in range(7000, 7010)] + [(b, 0, 0) for b in ("b.net/42", "b.net/7007", "é😀", "a" * 20000, "")]
    bodies = spark.createDataFrame([(i, *b) for i, b in enumerate(bodies)], "id long, body string, yes long, no long")
    fitted = urlfilter.cut(urlfilter.model(bodies))
    found = {r["id"]: r["step"] for r in urlfilter.scored(bodies, fitted).collect()}
    assert found.keys() == set(range(25)) and found[20] > 0 > found[21]
    for hot in (1, 20):
        monkeypatch.setattr(urlfilter, "HOT", hot)
        assert {r["id"]: r["step"] for r in urlfilter.scored(bodies, fitted).collect()} == found


def test_url_model_against_plain_counts(spark):
    bodies = [("ab", 3, 0), ("ab1", 0, 2), ("é/", 1, 1), ("", 0, 1), ("ba", 0, 0)]
    edge, most = urlfilter.EDGE, urlfilter.ORDER
    seen = [(edge * most + b + edge)[i : i + most + 1] for b, _, _ in bodies for i in range(len(b) + 1)]
    counts = [(g, *x[1:]) for x in bodies for g in [(edge * most + x[0] + edge)[i : i + most + 1] for i in range(len(x[0]) + 1)]]
    uniform = 1 / len({g[-1] for g in seen})

    def likelihood(gram: str, kind: int) -> float:
        if not gram:
            return uniform
        after = [(g[-len(gram) :], x[kind]) for g, *x in counts if g[-len(gram) :][:-1] == gram[:-1] and x[kind]]
        shorter = likelihood(gram[1:], kind)
        total, kinds = sum(n for _, n in after), len({g for g, _ in after})
        return (sum(n for g, n in after if g == gram) + kinds * shorter) / (total + kinds) if total else shorter

    found = {r["gram"]: (r["n"], r["ratio"]) for r in urlfilter.model(spark.createDataFrame(bodies, "body string, yes long, no long")).collect()}
    expected = {g: (seen.count(g), round((math.log(likelihood(g, 0)) - math.log(likelihood(g, 1))) * urlfilter.UNIT)) for g in set(seen)}
    assert found == expected
