"""Disguised personal data and license notices without their phrases, planted in prose: how many are found, and what else is."""

import random

from lexmill.llm import license_scan, pii

PROSE = "we walked along the river and talked about the plans for next year while it was getting dark at the mill near one of two bridges".split()


def prose(rnd, n):
    return " ".join(rnd.choice(PROSE) for _ in range(n))


def disguises(rnd):
    digits = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    spell = lambda s: " ".join(digits[int(c)] for c in s)
    name, host = rnd.choice(["jo.doe", "anna_b", "m-lee"]), rnd.choice(["example", "mail-host", "uni"])
    octets = [str(rnd.randrange(256)) for _ in range(4)]
    number = "4" + "".join(str(rnd.randrange(10)) for _ in range(14))
    number += next(str(d) for d in range(10) if pii.luhn(number + str(d)))
    phone = "49" + "".join(str(rnd.randrange(10)) for _ in range(8))
    look = {"a": "а", "e": "е", "o": "о"}
    return [
        ("email", f"{name} (at) {host} [dot] com"),
        ("email", f"{name} at {host} dot org"),
        ("email", f"{name} @ {host}.com"),
        ("email", "".join(look.get(c, c) for c in f"{name}@{host}.com")),
        ("email", f"{name}[@]{host}[.]net"),
        ("ip", "[.]".join(octets)),
        ("ip", " dot ".join(map(spell, octets))),
        ("ip", " dot ".join(octets)),
        ("phone", f"plus {spell(phone)}"),
        ("phone", "+" + "".join(chr(ord(c) + 0xFEE0) for c in phone)),
        ("card", spell(number)),
        ("card", "​".join([number[k : k + 4] for k in range(0, 16, 4)])),
    ]


def test_disguised_data_in_prose_is_found_and_prose_is_not():
    rnd, found, planted, false = random.Random(6), 0, 0, 0
    for _ in range(150):
        for kind, value in disguises(rnd):
            before, after = prose(rnd, rnd.randrange(3, 30)) + " also", "then " + prose(rnd, rnd.randrange(3, 30))
            text = f"{before}: {value}, {after}"
            spans = pii.disguised(text, pii.find(text))
            a, b = len(before) + 2, len(before) + 2 + len(value)
            planted += 1
            found += any(abs(x - a) <= 1 and abs(y - b) <= 1 for x, y in spans[kind])
            false += sum(y <= a or x >= b for own in spans.values() for x, y in own)
        text = prose(rnd, 200)
        false += sum(map(len, pii.disguised(text, pii.find(text)).values()))
    assert found >= 0.97 * planted and false == 0


def test_prose_with_domains_and_versions_is_clean():
    clean = [
        "look at example.com for more", "He works at night dot com was great", "sat at home.dot", "see you at www.site.org now", "version one dot two dot three dot four", "release 1 dot 2 dot 3 dot 4 is out",
        "we met at dawn dot by dot, and the shop at main street.corner", "she is good at dot com business", "the meeting at ten.thirty", "all at once dot it stopped", "point your browser at docs.example.org or mail.example.org",
        "section two dot one dot three dot five says so", "they arrived at noon. Dot was there", "it is at least dot matrix quality", "buy at shop.example.co.uk today", "prices at 10.50 and 20.75",
    ]
    rnd = random.Random(8)
    for text in clean:
        for wrapped in (text, f"{prose(rnd, 20)} {text} {prose(rnd, 20)}", text.capitalize() + "."):
            assert not any(pii.disguised(wrapped, pii.find(wrapped)).values()), wrapped
    for text in ("write to jo at example dot com", "jo.doe at mail-host dot example dot org", "jo [at] example [dot] com", "host 10 dot 0 dot 0 dot 1 is down"):
        assert any(pii.disguised(text, pii.find(text)).values()), text


def test_long_unrelated_paragraphs_hold_no_notice(spark):
    rnd, rows = random.Random(9), []
    notices = [w for _, text in license_scan.TEMPLATES for w in text.split()]
    for i in range(200):  # the words of the notices themselves, scattered over one long paragraph
        rows.append((i, " ".join(rnd.choice(notices) if rnd.random() < 0.3 else rnd.choice(PROSE) for _ in range(rnd.choice((300, 800, 3000))))))
    embedded = [(1000 + k, f"{prose(rnd, 300)} {text} {prose(rnd, 300)}") for k, (_, text) in enumerate(license_scan.TEMPLATES)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame([*rows, *embedded], "doc_id long, text string")).collect()}
    assert sum(got[i].labels != got[i].base_labels for i in range(200)) == 0
    assert all(label in got[1000 + k].labels.split(",") for k, (label, _) in enumerate(license_scan.TEMPLATES))


def test_notices_without_phrases_are_found(spark):
    rnd, rows, want = random.Random(7), [], {}
    notices = [(label, text) for label, text in license_scan.TEMPLATES if not any(p in " ".join(license_scan_words(text)) for p, _ in license_scan.PHRASES)]
    assert len(notices) >= 20
    for i in range(400):
        text = prose(rnd, 60)
        if i % 2:
            label, notice = rnd.choice(notices)
            words = notice.split()
            for _ in range(len(words) // 20):  # a few words changed
                words[rnd.randrange(len(words))] = rnd.choice(PROSE)
            text = f"{text}\n\n{' '.join(words)}\n\n{prose(rnd, 40)}"
            want[i] = label
        rows.append((i, text))
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = sum(label in got[i].labels.split(",") for i, label in want.items())
    assert hit >= 0.95 * len(want)
    assert all(got[i].labels == "" and got[i].score == 0 for i in range(0, 400, 2)) and all(r.base_labels == "" for r in got.values())


def license_scan_words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
