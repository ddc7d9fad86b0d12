"""Personal data next to other numbers."""

from patchlake.llm import pii


def kinds_of(spark, texts):
    """By text: the kinds found, and the new text."""
    made = pii.pseudonymised(spark.createDataFrame([(t, t) for t in texts], "old string, text string"), "text", "key").collect()
    return {r.old: (list(r.entities), r.text) for r in made}


def test_numbers_side_by_side(spark):
    cases = {
        "4111111111111111 12/27": (["card"], ["4111111111111111"], ["12/27"]), "4111 1111 1111 1111 97.51.17.173": (["card", "ip"], ["1111 1111", "97.51.17.173"], []),
        "123-45-6789 2024": (["ssn"], ["123-45-6789"], [" 2024"]), "123-45-6789 555-123-4567": (["ssn", "phone"], ["123-45-6789", "123-4567"], []),
        "555-123-4567 100": (["phone"], ["555-123-4567"], [" 100"]), "100 555-123-4567 123-45-6789": (["phone", "ssn"], ["123-4567", "123-45-6789"], ["100 "]),
        "12 4111-1111-1111-1111 123 x": (["card"], ["1111-1111"], ["12 ", " 123 x"]), "4111111111111111 5500005555555559": (["card", "card"], ["4111111111111111", "5500005555555559"], []),
        "378282246310005, 3782 822463 10005-1": (["card", "card"], ["378282246310005", "822463"], ["-1"]), "1234 5678 9012 3456 or 1234567890123456": ([], [], ["1234 5678 9012 3456 or 1234567890123456"]),
        "DE89 3704 0044 0532 0130 00 4111 1111 1111 1111": (["iban", "card"], ["3704", "1111 1111"], []), "41 11 11 11 11 11 11 11": (["card"], ["11 11 11"], []),
        "4111111111111111 " * 3 + "9" * 40: (["card"] * 3, ["4111111111111111"], ["9" * 40]),
    }
    got = kinds_of(spark, cases)
    for text, (kinds, gone, stay) in cases.items():
        assert got[text][0] == kinds, (text, got[text])
        assert not any(x in got[text][1] for x in gone) and all(x in got[text][1] for x in stay), (text, got[text])


def test_phones_of_several_countries(spark):
    phones = ["+49 711 1234567", "+49 (0)711 123-4567", "+49 711/1234567", "+33 1 23 45 67 89", "+34 612 34 56 78", "+1 555 123 4567", "+442079460123", "0711 123456", "0711/1234567", "(0711) 123456", "030 12345678", "01 23 45 67 89",
              "01.23.45.67.89", "020 7946 0123", "612 34 56 78", "912 345 678", "(269) 555-3296"]
    cases = {f"{a} {p}{b}": p for a, b in (("Call", "."), ("Tél.", ", ok")) for p in phones} | {"Telefon: 5551234567": "5551234567"}
    for text, (kinds, made) in kinds_of(spark, cases).items():
        assert kinds == ["phone"] and cases[text] not in made and len(made) == len(text), (text, kinds, made)
    none = ["01-02-2024 and 01.02.2024 or 01/02/2024 10:30", "05 06 2024", "0.123456789", "id 5551234567", "007 05", "2024-01-15 09:30", "v01.02.03", "0,123 456"]
    for text, (kinds, made) in kinds_of(spark, none).items():
        assert kinds == [] and made == text, (text, kinds, made)
    got = kinds_of(spark, ["0711 1234567 123-45-6789", "+49 711 1234567 4111 1111 1111 1111", "+33 1 23 45 67 89 123-45-6789"])
    assert [k for k, _ in got.values()] == [["phone", "ssn"], ["phone", "card"], ["phone", "ssn"]] and not any(x in m for _, m in got.values() for x in ("1234567", "123-45-6789", "1111"))
