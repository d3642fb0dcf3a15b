import re

from quillspark.llm import pii

TEXT = (
    "Mail hein.19@mail5.example.com or Hein.19@Mail5.Example.com; call +1 (743) 555-3824 or +1-743-555-3824. "
    "IP 8.196.197.208, card 4111 1111 1111 1111, 078-05-1120, DE89370400440532013000. "
    "Mrs. Anna Keller met Herr Weber; later Keller called Weber. Господин Петров came. Peter Schmidt left."
)


def swapped(text, key=pii.KEY):
    make, out, at = pii.surrogates(key), [], 0
    for s, e, k in pii.detect(text):
        out += [text[at:s], pii.pour(k, text[s:e], make(k, pii.normal(k, text[s:e])))]
        at = e
    return "".join([*out, text[at:]])


def test_detects_all_types():
    kinds = [k for _, _, k in pii.detect(TEXT)]
    assert {k: kinds.count(k) for k in set(kinds)} == {"email": 2, "phone": 2, "ip": 1, "card": 1, "ssn": 1, "iban": 1, "given_f": 1, "given_m": 1, "surname": 5, "surname_m": 1}


def test_formats_gender_script_and_coreference():
    new = swapped(TEXT)
    for s, e, _ in pii.detect(TEXT):
        assert TEXT[s:e] not in new
    a, b = re.search(r"Mail (\S+) or (\S+);", new).groups()
    assert a == b.lower() and a.endswith(".example.com")
    phones = re.search(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1-\d{3}-\d{3}-\d{4})", new).groups()
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4})", new)[1].replace(" ", "")
    assert pii.luhn(card) and card[0] == "4"
    iban = re.search(r"DE\d{20}", new)[0]
    assert pii._iban_check("DE", iban[4:]) == iban[2:4]
    first, last = re.search(r"Mrs\. (\S+) (\S+) met", new).groups()
    assert first in pii.GIVEN["f", "latin"] and re.search(rf"later {last} called", new)
    assert re.search(r"Господин [А-Я][а-я]+ов came", new)
    assert new.startswith("Mail ") and "card" in new and new.endswith("left.")


def test_key_and_determinism():
    assert swapped(TEXT) == swapped(TEXT) != swapped(TEXT, b"another")


def test_given_names_stay_distinct():
    make = pii.surrogates(pii.KEY)
    for (gender, _), names in pii.GIVEN.items():
        new = [make(f"given_{gender}", n) for n in names]
        assert len(set(new)) == len(names) and all(a != b for a, b in zip(new, names, strict=True))


def test_ordinary_text_is_left_alone():
    for text in ("Version 3.4.5 has 12345 rows and 99% of 1,000,000.", "Thblere of then, Edtioner in Inea.", "10.11.2024 12:30", "A1B2", "Und Und Und"):
        assert pii.detect(text) == []


def test_clashes_are_resolved(spark):
    values = spark.createDataFrame([("surname", pii.surrogates(pii.KEY)("surname", f"Name{i}")) for i in range(300)] + [("surname", f"Name{i}") for i in range(3000)] + [("ip", f"10.0.{i // 250}.{i % 250 + 1}") for i in range(500)], "kind string, value string").distinct()
    got = pii.assigned(values, pii.KEY).toPandas()
    assert len(got) == values.count()
    for _, g in got.groupby("kind"):
        assert g["surrogate"].is_unique and not set(g["surrogate"]) & set(g["value"])


def test_whole_table_keeps_rows_columns_and_clean_texts(spark, edge, nothing):
    out = pii.replace(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    before = {(r.doc_id, r.text) for r in edge.collect()}
    after = {(r.doc_id, r.text) for r in out.collect()}
    assert after - before == {(10, next(t for i, t in after if i == 10))} and (10, "write to a.b@c.org now") not in after
    assert pii.replace(nothing).count() == 0


def test_same_value_same_surrogate_across_documents(spark):
    docs = spark.createDataFrame([(i, f"row {i % 3}: reach me at x{i % 4}.y@z.org") for i in range(40)], "doc_id long, text string")
    got = pii.replace(docs, entities_col="e").collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id % 4, set()).add(re.search(r"at (\S+)", r.text)[1])
    assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == 4
    assert all(e.kind == "email" for r in got for e in r.e)


def test_planted_values_beside_each_other_leave_the_text():
    phone, ip, card, ssn = "+1 (826) 555-4081", "190.137.223.204", "4111 1111 1111 1111", "078-05-1120"
    planted = [(phone, ip), (phone, card), (card, ssn), (phone, ssn), (phone, "12345678"), (phone, "1234 5678 9012"), (ip, phone), (card, phone)]
    for pair in planted:
        new = swapped(f"see {' '.join(pair)} there")
        assert pair[0] not in new, pair
        assert pair[1] not in new or pair[1][0] == "1" and "." not in pair[1], pair
    assert pii.detect("code +123456789012345678 end") == []


def test_planted_names_in_runs_of_capitals_leave_the_text():
    for text, words in {
        "María Lopez\nJohn Smith": "María Lopez John Smith",
        "Today Our Friend Anna Schmidt": "Anna Schmidt",
        "One Two Three Four Five Six Peter Weber": "Peter Weber",
        "Anna Keller Mr. Weber María Lopez Dr Braun": "Anna Keller Weber María Lopez Braun",
        "Anna María Carmen Elena Lopez": "Anna María Carmen Elena Lopez",
        "María Lopez John": "María Lopez John",
    }.items():
        found = {text[s:e]: k for s, e, k in pii.detect(text)}
        assert list(found) == words.split(), text
        new = dict(zip(text.split(), swapped(text).split(), strict=True))
        assert all(new[w] != w for w in words.split())
    kinds = [k for _, _, k in pii.detect("María Lopez\nJohn Smith")]
    assert kinds == ["given_f", "surname", "given_m", "surname"]


def test_names_with_particles_initials_and_capitals():
    for text, words in {
        "Mr. John McDonald met Mrs O'Brien.": "John McDonald O'Brien",
        "MR. JOHN SMITH left, Smith too": "JOHN SMITH",
        "John F. Kennedy": "John F Kennedy",
        "Anna von der Heide": "Anna Heide",
        "Marie Garcia-Lopez": "Marie Garcia-Lopez",
        "Jean-Pierre Dupont’s": "Jean-Pierre Dupont",
    }.items():
        assert [text[s:e] for s, e, _ in pii.detect(text)] == words.split(), text
        new = swapped(text)
        assert all(w not in new for w in words.split() if len(w) > 1)
    a, b = re.fullmatch(r"Dr\. (\S+ \S+) and Mr\. (\S+ \S+)", swapped("Dr. Kim Lee and Mr. Kim Lee")).groups()
    assert a == b  # the same person, whatever the honorific
    assert re.fullmatch(r"[A-Z][a-z]{5}-[A-Z][a-z]{4}", swapped("Marie Garcia-Lopez").split()[1])
    upper, title = re.fullmatch(r"MR\. (\S+) and Mr\. (\S+)", swapped("MR. SMITH and Mr. Smith")).groups()
    assert upper == title.upper()
    he, she = re.fullmatch(r"Господин (\S+) и Госпожа (\S+)", swapped("Господин Петров и Госпожа Петрова")).groups()
    assert he + "а" == she and he.endswith("ов")


def test_every_shape_is_permuted_without_a_fixed_point():
    make = pii.surrogates(pii.KEY)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for kind, values in {
        "email": [f"{x}@b.com" for x in letters],
        "phone": [f"+49|49{i:02d}" for i in range(100)],
        "ssn": [f"{i:03d}" for i in range(1000)],
        "ip": [f"10.0.0.{i}" for i in range(256)],
        "name": [f"{x}{y}" for x in letters for y in letters],
        "card": [x for x in (f"4{i:03d}" for i in range(1000)) if pii.luhn(x)],
    }.items():
        for step in (1, 2):
            new = [make(kind, v, step) for v in values]
            assert len(set(new)) == len(values) and all(a != b for a, b in zip(new, values, strict=True)), kind
            assert all(make.shape(kind, a) == make.shape(kind, b) for a, b in zip(new, values, strict=True)), kind


def test_crowded_shapes_stay_distinct(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [("email", f"{x}@example.org") for x in "0123456789"] + [("email", f"{x}{y}@example.com") for x in letters for y in letters] + [("email", f"{x}@b.com") for x in letters] + [("name", f"{x}{y}o") for x in "bcd" for y in "aei"]
    got = pii.assigned(spark.createDataFrame(rows, "kind string, value string"), pii.KEY).collect()
    assert {(r.kind, r.value) for r in got} == set(rows) and len(got) == len(rows)
    assert len({(r.kind, r.surrogate) for r in got}) == len(rows) and all(r.surrogate != r.value for r in got)
    real = {r.value for r in got if r.kind == "name"}
    assert not real & {r.surrogate for r in got if r.kind == "name"}  # not crowded: no other real value


def test_whole_table_against_one_text_at_a_time(spark):
    """Distinctness, coreference and formats over a table; what detect() finds in each text, and nothing else, is replaced."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in pii.replace(docs, key=pii.KEY, entities_col="found").collect()}
    assert got.keys() == texts.keys()
    to, back = {}, {}
    for i, text in texts.items():
        new, at, where = got[i].text, 0, 0
        assert [(e.start, e.end, e.kind) for e in got[i].found] == pii.detect(text or "")
        for e in got[i].found:
            assert new[where : where + e.start - at] == text[at : e.start]
            where += e.start - at
            v = pii.normal(e.kind, text[e.start : e.end])
            kind = pii.family(e.kind, v)
            end = where + (e.end - e.start if kind != "given" and kind != "ip" else len(re.match(r"[\d.]+|[\w-]+", new[where:])[0]))
            s = pii.normal(e.kind, new[where:end])
            assert to.setdefault((kind, v), s) == s and back.setdefault((kind, s), v) == v
            at, where = e.end, end
        assert new is None and text is None or new[where:] == text[at:]
    assert len(to) > 50 and not {k for k in to if k[0] not in ("given", "initial")} & {k for k in back if k[0] not in ("given", "initial")}


def test_many_finds_in_a_text_take_time_in_proportion():
    text = " ".join(f"a{i}@b{i}.org" for i in range(20_000))
    assert len(pii.detect(text)) == 20_000


def test_key_of_the_session(spark):
    assert len(pii.session_key(spark)) == 32 and pii.session_key(spark) == pii.session_key(spark) != pii.KEY
    spark.conf.set("spark.quillspark.pii.key", "mine")
    try:
        assert pii.session_key(spark) == b"mine"
    finally:
        spark.conf.unset("spark.quillspark.pii.key")
