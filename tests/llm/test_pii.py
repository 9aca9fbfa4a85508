import re

import pytest
from pyspark.sql import functions as F

from strandline.llm import pii
from strandline.llm.common import Scratch
from strandline.llm.pii import ANY, COUNTRY_CODE, PATTERNS, entities, exceptions, pseudonymised


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(d[::2] + [x * 2 - 9 if x > 4 else x * 2 for x in d[1::2]]) % 10 == 0


TEXTS = {
    1: "write to Anna.9@mail.example.org or call +1 (017) 555-7713, card 4539 1488 0343 6467 ok",
    2: "ANNA.9@mail.example.org again, card 4539148803436467, not a card 4539148803436466, host 10.1.2.3.",
    3: 'token = "4534254f83b7e27b3670756d7cab6da61ccfcea9" and Mrs. Maria Schmidt, Mr Schmidt, г-жа Анна Белова',
    4: "clean text with version 1.2.3.4.5, year 2024-05-06 and 12345678901234567890",
    5: None,
    6: "",
}


def run(spark, key="k"):
    df = spark.createDataFrame([(i, t, "x") for i, t in TEXTS.items()] + [(1, TEXTS[1], "y")], "doc_id long, text string, __n string")
    return df, pseudonymised(df, key)


def test_surrogates(spark):
    df, out = run(spark)
    assert out.columns[:3] == df.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(TEXTS) + 1
    assert [got[i]["__p_n"] for i in (1, 2, 3, 4, 5, 6)] == [3, 3, 4, 0, 0, 0]
    assert got[4]["text"] == TEXTS[4] and got[5]["text"] is None and got[6]["text"] == ""
    mail = re.findall(r"\S+@\S+(?=[ ,])", got[1]["text"] + " " + got[2]["text"])
    assert mail[0] == mail[1] and "anna" not in mail[0].lower() and re.fullmatch(r"[a-z]{4}\.\d@m[0-9a-f]{8}\.example\.com", mail[0])
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", got[1]["text"])[0]
    assert card.replace(" ", "") in got[2]["text"] and luhn(card.replace(" ", "")) and "4539148803436467" not in got[2]["text"]
    assert "4539148803436466" in got[2]["text"] and "10.1.2.3" not in got[2]["text"]
    assert re.search(r"\+1\d* ?\(\d{3}\) \d{3}-\d{4}|\+\d \(\d{3}\) \d{3}-\d{4}", got[1]["text"]) and "555-7713" not in got[1]["text"]
    assert re.search(r'token = "[0-9a-f]{40}"', got[3]["text"]) and "4534254f" not in got[3]["text"]
    assert re.search(r"Mrs\. [A-Z]\w+ [A-Z]\w+, Mr [A-Z]\w+, г-жа [А-Я]\w+ [А-Я]\w+а", got[3]["text"]) and "Schmidt" not in got[3]["text"]


def test_keyed_and_repeatable(spark):
    one, two, other = ({r["doc_id"]: r["text"] for r in run(spark, k)[1].collect()} for k in ("k", "k", "l"))
    assert one == two != other


def test_collisions_are_resolved(spark, monkeypatch):
    monkeypatch.setattr(pii, "syllables_for", lambda n: 1)  # 16 * 4 surnames
    names = [f"Mr {a}{b}" for a in ("Adler", "Braun", "Conrad", "Dietz") for b in ("er", "mann", "sen", "ski", "berg", "feld")]
    docs = spark.createDataFrame([(i, f"{n} came") for i, n in enumerate(names)], "doc_id long, text string")
    with Scratch(spark, "test") as scratch:
        extra, syllables = exceptions(entities(docs), "k", scratch)
        assert syllables == 1 and extra.count() > 0
    out = [r["text"] for r in pseudonymised(docs, "k").collect()]
    assert len(set(out)) == len(names) and not set(out) & {f"{n} came" for n in names}


def rewritten(spark, texts, key="k"):
    out = pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), key).collect()
    return {r["doc_id"]: r for r in out}


def test_one_person_by_several_names(spark):
    got = rewritten(spark, [
        "Mr John Smith met Mr Smith. Dr. Smith and John Smith agreed, said Smith; Smithson did not.",
        "Mrs Ana Smith and Mr John Smith came.",
        "г-жа Анна Белова и г-н Белов. Анна Белова ушла.",
        "John Smith without a title stays, as does Smith.",
    ])
    m = re.fullmatch(r"Mr (\w+(?:-\w+)*) (\w+) met Mr (\w+)\. Dr\. (\w+) and (\w+(?:-\w+)*) (\w+) agreed, said (\w+); Smithson did not\.", got[0]["text"])
    assert m and len({m[2], m[3], m[4], m[6], m[7]}) == 1 and m[1] == m[5] and m[2] != "Smith" and got[0]["__p_n"] == 5
    n = re.fullmatch(r"Mrs (\S+) (\w+) and Mr (\S+) (\w+) came\.", got[1]["text"])
    assert (n[2], n[3], n[4]) == (m[2], m[1], m[2]) and n[1] in pii.GIVEN["latin"]["f"]
    c = re.fullmatch(r"г-жа (\S+) (\S+)а и г-н (\S+)\. (\S+) (\S+)а ушла\.", got[2]["text"])
    assert c and c[2] == c[3] == c[5] and c[1] == c[4] and c[2] != "Белов"
    assert got[3]["text"].startswith("John Smith without") and got[3]["__p_n"] == 0


def rest97(x):
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def test_formats_of_numbers(spark):
    got = rewritten(spark, [
        "call +49 30 123456 or +4930123456 or +1 (212) 555-0143 or +380 44 123 45 67",
        "pay DE89 3704 0044 0532 0130 00 or DE89370400440532013000 now",
        "hosts 2001:db8:0:0:1:0:0:1, fe80::1ff:fe23:4567:890a and ::1, std::vector, at 12:30:45, ab::cd",
        "SSN 123-45-6789, not 123-45-67890",
    ])
    phones = re.fullmatch(r"call (\+49 \d\d \d{6}) or (\+49\d{8}) or (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+380 \d\d \d{3} \d\d \d\d)", got[0]["text"])
    assert phones and phones[1].replace(" ", "") == phones[2] != "+4930123456"
    a, b = re.fullmatch(r"pay (DE[\d ]{25}) or (DE\d{20}) now", got[1]["text"]).groups()
    assert a.replace(" ", "") == b != "DE89370400440532013000" and rest97(b) == 1 and [len(x) for x in a.split()] == [4, 4, 4, 4, 4, 2]
    hosts = re.fullmatch(r"hosts ([0-9a-f:]+), ([0-9a-f:]+) and ::1, std::vector, at 12:30:45, ab::cd", got[2]["text"])
    assert hosts and got[2]["__p_n"] == 2 and [len(x) for x in hosts[1].split(":")] == [4, 3, 1, 1, 1, 1, 1, 1] and [len(x) for x in hosts[2].split(":")] == [4, 0, 3, 4, 4, 4]
    assert got[3]["__p_n"] == 1 and "123-45-6789," not in got[3]["text"] and "123-45-67890" in got[3]["text"]


def test_country_codes():
    for code in ("1", "7", "20", "27", "30", "36", "39", "49", "81", "98", "351", "380", "420", "971"):
        assert re.match(COUNTRY_CODE, code + "5551234")[0] == code


def parts(text):
    """Entities of a text with their places, one pattern at a time at each place: the brute-force form of ANY, types by precedence."""
    one = {k: re.compile(p.replace(r"\p{Lu}", "[A-ZÀ-ÖØ-ÞΑ-ΩΆ-ΏА-ЯЁ]").replace(r"\p{Ll}", "[a-zß-öø-ÿα-ώа-яё]").replace("*+", "*").replace("++", "+"), re.ASCII) for k, p in PATTERNS.items()}
    at, out = 0, []
    while at < len(text):
        for k, p in one.items():
            m = p.match(text, at)
            if m and m[0]:
                digits = re.sub(r"\D", "", m[0], flags=re.ASCII)
                if k != "card" or luhn(digits):
                    out.append((m.start(), m.end(), k))
                at = m.end() - 1
                break
        at += 1
    return out


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {r["doc_id"]: r for r in pseudonymised(docs, "k").collect()}
    assert found.keys() == texts.keys() and len(ANY) > 100
    real, given = {}, {}
    for i, text in texts.items():
        spans = parts(text or "")
        if not any(k == "person" for _, _, k in spans):
            assert found[i]["__p_n"] == len(spans) and found[i]["__p_kinds"] == sorted({k for _, _, k in spans}), i
            # what stands between entities is untouched, and each entity has one surrogate
            at, rest = 0, found[i]["text"] or ""
            for a, b, k in spans:
                between = text[at:a]
                assert rest.startswith(between)
                rest, at = rest[len(between) :], b
                if k in ("secret", "national", "ip", "phone", "card", "iban", "ip6"):
                    put, rest = rest[: b - a] if k != "ip" else re.match(r"[\d.]*\d", rest)[0], rest[b - a if k != "ip" else len(re.match(r"[\d.]*\d", rest)[0]) :]
                else:
                    put = re.match(r"[A-Za-z0-9][\w.+%-]*@m[0-9a-f]{8}\.example\.com", rest, re.ASCII)[0]
                    rest = rest[len(put) :]
                form = re.sub(r"\W", "", text[a:b]).lower() if k not in ("email", "ip", "ip6") else text[a:b].lower()
                other = re.sub(r"\W", "", put).lower() if k not in ("email", "ip", "ip6") else put.lower()
                assert given.setdefault((k, form), other) == other
                real.setdefault(k, set()).add(form)
            assert rest == (text or "")[at:]
        else:
            assert found[i]["__p_n"] >= len(spans)
    assert len(given) > 12 and len(set(given.values())) == len(given)
    assert not any(put in real[k] for (k, _), put in given.items())


def test_nulls_ties_clashes_and_long_texts(spark):
    long_ = "word " * 200_000 + "mail a.b@c.example.org and Mr Brown " + "x" * 100_000
    rows = [(None, "a.b@c.example.org", "1"), (None, None, "2"), (7, long_, "3"), (7, "Mr Brown", "4"), (7, "Mr Brown", "4")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    out = pseudonymised(df, "k").collect()
    by = {r["kind"]: r for r in out}
    assert len(out) == 5 and by["2"]["text"] is None and by["1"]["text"] in by["3"]["text"] and by["4"]["text"] in by["3"]["text"]
    assert len(by["3"]["text"]) > 1_000_000 and by["3"]["__p_n"] == 2


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pseudonymised(df, "k").count() == 0 and entities(df).where(F.col("kind").isNull()).count() == 0


def test_secrets_in_either_case(spark):
    secret = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
    texts = [f"TOKEN = \"{x}\"" for x in (secret, secret.lower(), secret[:20].lower() + secret[20:], "AB12" + secret[4:32])] + ["ABCDEF0123 is too short"]
    out = pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k")
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[i]["__p_n"] for i in range(5)] == [1, 1, 1, 1, 0] and got[3]["__p_kinds"] == ["secret"]
    upper, lower, mixed = (re.fullmatch(r'TOKEN = "([0-9a-fA-F]{40})"', got[i]["text"])[1] for i in range(3))
    assert upper == lower.upper() != secret and lower == upper.lower() == mixed.lower()
    assert re.fullmatch(r'TOKEN = "[0-9A-F]{32}"', got[3]["text"]) and secret[4:32] not in got[3]["text"]


def test_names_of_one_title_do_not_run_out(spark):
    def names(title, first, alphabet, n):
        word = lambda k: "".join(alphabet[k // len(alphabet) ** p % len(alphabet)] for p in range(6))
        return [f"{title} {first}{word(k)}" for k in range(n)]

    all_ = names("Mr", "Q", "abcdefgh", 10_000) + names("г-н", "Ш", "абвгдежз", 3_000)
    docs = spark.createDataFrame([(i, f"{n} came") for i, n in enumerate(all_)], "doc_id long, text string")
    out = [r["text"] for r in pseudonymised(docs, "k").collect()]
    assert len(set(out)) == len(all_) and not set(out) & {f"{n} came" for n in all_}
    assert sum(x.startswith("Mr ") for x in out) == 10_000


def test_short_addresses_and_numbers_do_not_run_out(spark):
    hexes = "0123456789abcdef"
    addresses = [f"{a}::{b}" for a in hexes for b in hexes if a.isdigit() or b.isdigit()][:220]
    phones = [f"+211 {k:05d}" for k in range(0, 100_000, 7)]
    lines = [f"host {x} up" for x in addresses] + [f"call {x} now" for x in phones]
    out = [r["text"] for r in pseudonymised(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4), "k").collect()]
    assert len(set(out)) == len(lines) and not set(out) & set(lines)
    for t in out:
        assert re.fullmatch(r"host [0-9a-f]{1,4}::[0-9a-f]{1,4} up|call \+211 \d{5,12} now", t), t


def test_a_full_form_exchanges_its_values(spark, monkeypatch):
    own = pii._surrogate
    monkeypatch.setattr(pii, "ROUNDS", 2)
    # as if no other number existed: every attempt gives the entity itself
    monkeypatch.setattr(pii, "_surrogate", lambda kind_, canon, *rest: F.when(kind_ == "national", canon).otherwise(own(kind_, canon, *rest)))
    numbers = [f"{k:03d}-{k % 90 + 10}-{k * 7:04d}" for k in range(1, 300)]
    lines = [f"id {x} of Mr Stone" for x in numbers]
    out = [r["text"] for r in pseudonymised(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), "k").collect()]
    put = {re.match(r"id (\S+) of Mr \w+", t)[1] for t in out}
    assert put == set(numbers) and not any(a.split()[1] == b.split()[1] for a, b in zip(sorted(lines), [t for _, t in sorted(zip(lines, out, strict=True))], strict=True))
    assert len({t.rsplit(" ", 1)[1] for t in out}) == 1 and "Stone" not in out[0]
    monkeypatch.setattr(pii, "ROUNDS", 1)
    with pytest.raises(ValueError, match="no other value"):
        pseudonymised(spark.createDataFrame([(1, "id 123-45-6789")], "doc_id long, text string"), "k")
