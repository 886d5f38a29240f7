"""Personal data and secrets: base spans against plain regular expressions; added spans on planted cases."""

import hashlib
import random
import re
from collections import Counter

from tessera.llm import pii, secrets


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def count_digits(text):
    return sum(c in "0123456789" for c in text)


def plain_pii(text):
    found = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    found += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= count_digits(m.group()) <= 19 and luhn(re.sub("[^0-9]", "", m.group()))]
    return found + [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= count_digits(m.group()) <= 15]


def plain_secrets(text):
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    return found + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]


def listed(found):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def compared(got, rows, plain, kinds):
    wanted, text_of = Counter(), {}
    for doc, text in rows:
        found = plain(text)
        n = Counter(f[3] for f in found)
        wanted[(doc, *(n[k] for k in kinds), hashlib.sha256(listed(found).encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:-1] for r in got) == wanted
    for r in got:
        base = ",".join(s for s in r["spans"].split(",") if s.split(":")[0] in kinds)
        assert hashlib.sha256(base.encode()).hexdigest() == r["base_sha256"]
        starts = [int(s.split(":")[1]) for s in r["spans"].split(",") if s]
        assert starts == sorted(starts)
    return text_of


def test_pii(docs, rows):
    compared(pii.scan(docs).collect(), rows, plain_pii, pii.BASE)


def test_pii_random_texts():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice(["@", ".", "a", "B", "1", "23", "255", " ", "-", "+", "(", ")", "4111111111111111", "%", "é"]) for _ in range(rng.randint(0, 40)))
        assert pii.listed([s for s in pii.find(text) if s[2] in pii.BASE]) == listed(plain_pii(text)), text


def test_pii_added():
    text = "see https://a.b/c?d=1, account no. 12345678; iban DE89 3704 0044 0532 0130 00 but iban DE88 3704 0044 0532 0130 00"
    found = [(text[a:b], kind) for a, b, kind in pii.find(text) if kind in pii.ADDED]
    assert found == [("https://a.b/c?d=1", "url"), ("12345678", "account"), ("DE89 3704 0044 0532 0130 00", "account")]
    assert pii.mask("mail x@y.zz now") == "mail <email> now"


def test_secrets(docs, rows):
    compared(secrets.scan(docs).collect(), rows, plain_secrets, secrets.KINDS[:3])


def test_randomness_finds_noise_and_leaves_words(spark):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    noise = [(k, "key " + "".join(rng.choice(letters) for _ in range(40)) + " end") for k in range(60)]
    words = [(1000 + k, f"read section{k}_of_the_long_manual_chapter_{k}_{k}") for k in range(60)]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(noise + words, "doc_id long, text string")).collect()}
    assert sum("random" in got[k] for k, _ in noise) >= 54
    assert sum("random" in got[k] for k, _ in words) <= 6


def test_redact(spark, hard):
    out = secrets.redact(hard)
    assert out.schema.names == hard.schema.names and out.count() == hard.count()
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[18] == next(r["text"] for r in hard.where("doc_id = 18").collect()) and got[1] is None
    assert "hunter22" not in got[21] and "deadbeef" in got[21] and "0123456789abcdef" not in got[21]


def test_empty(empty):
    assert pii.scan(empty).count() == secrets.scan(empty).count() == secrets.redact(empty).count() == 0


def test_random_spans_tell_noise_from_written_words(spark):
    """False discovery is counted against ordinary text: joined words stay, random strings are found."""
    import random
    import string

    from tessera.llm import secrets

    rng = random.Random(3)
    words = ["river", "castle", "window", "market", "summer", "garden", "letter", "bridge", "forest", "silver", "orange", "planet", "border", "copper", "engine", "harbor"]

    def written(k):
        some = [rng.choice(words) for _ in range(rng.randint(4, 8))]
        return ["_".join(some), "".join(w.title() for w in some), "/".join(some) + f"/{rng.randint(2000, 2030)}", "".join(some)][k % 4]

    noise = string.ascii_letters + string.digits + "+/"
    rows = [(k, f"see {written(k)} there") for k in range(600)] + [(1000 + k, "see " + "".join(rng.choice(noise) for _ in range(40)) + " there") for k in range(60)]
    found = {r["doc_id"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() if "random" in r["spans"]}
    assert sum(k < 1000 for k in found) <= 0.05 * len(found) and sum(k >= 1000 for k in found) >= 50


def test_many_matches_in_one_text(spark):
    from tessera.llm import secrets

    text = "é " + " ".join(f"{k:032x}" for k in range(4000)) + " ü"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secrets.scan(docs).first()["n_hex"] == 4000
    assert secrets.redact(docs).first()["text"] == "é " + " ".join(["[SECRET]"] * 4000) + " ü"
