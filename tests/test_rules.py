import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sievetide.config import ReviewConfig, Subject
from sievetide.functions import subject as S
from sievetide.functions import text as T
from sievetide.operators import cascade, chat, dedup, images, insights, jobs, ledger, numbering, sheets, verdicts
from sievetide.sources import parsers, scans


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr).first()[0]


PERSON = Subject(name="Vera Olin", email="vera.olin@work.example", personal_email="vo@home.example", aliases=("V. Olin",))


def test_tokens():
    assert S.tokens(PERSON) == ["vera olin", "vera", "olin", "v. olin", "vera.olin@work.example", "vera.olin", "vo@home.example"]
    assert S.identifiers(PERSON) == ["vera olin", "v. olin", "vera.olin@work.example", "vo@home.example"]
    assert S.tokens(Subject()) == []


@pytest.mark.parametrize(("text", "hit"), [("ask vera now", True), ("veranda", False), ("éolin!", True), ("OLIN", True), ("", False), ("v. olin", True), ("vxolin", False)])
def test_mentions(spark, text, hit):
    assert one(spark, S.mentions(F.col("x"), S.tokens(PERSON)), x=text) is hit


def test_no_tokens_mention_everything(spark):
    assert one(spark, S.mentions(F.col("x"), []), x="anything") is True


@pytest.mark.parametrize(("text", "hit"), [("strictly CONFIDENTIAL.", True), ("MICROSOFT", False), ("the CROs", True), ("privilegedly", False), ("xConfidential", False)])
def test_keywords(spark, text, hit):
    assert one(spark, S.has_keyword(F.col("x"), ReviewConfig().keywords), x=text) is hit


def test_disclaimer_is_cut(spark):
    mail = "Hello\r\nsee below\nKind regards,\nVera\nThis email is confidential"
    assert one(spark, T.strip_signature(F.col("x")), x=mail) == "Hello\nsee below"
    assert one(spark, T.strip_notice(F.col("x")), x="a\nThanks\nThis message and any attachments are privileged\nb") == "a\nThanks\n"


@pytest.mark.parametrize(("ms", "label"), [(0, "00:00:00"), (359_999_999, "99:59:59"), (360_000_000, "100:00:00"), (700_000_000, "194:26:40"), (2_800_000_000, "777:46:40")])
def test_clock_keeps_all_hours(spark, ms, label):
    assert one(spark, T.clock(F.col("x")), x=ms) == label


@pytest.mark.parametrize(("n", "label", "upto_mb"), [(1023, "1023 B", "1023 B"), (1792, "1.8 KB", "1.8 KB"), (1 << 20, "1.0 MB", "1.0 MB"), (1 << 30, "1.0 GB", "1024.0 MB"), (2_800_000_000, "2.6 GB", "2670.3 MB")])
def test_bytes_beyond_the_last_unit(spark, n, label, upto_mb):
    assert one(spark, T.bytes_label(F.col("x")), x=n) == label
    assert one(spark, T.bytes_label(F.col("x"), ("KB", "MB")), x=n) == upto_mb


def test_formats_of_large_keys(spark, duck, same, tmp_path):
    """The query's rows beyond 99 hours and 1024 MB."""
    from sievetide.plans.registry import ORACLES, QUERIES

    duck.execute(f"COPY (SELECT * REPLACE (p_partkey + shift AS p_partkey) FROM part, (VALUES (0), (8000), (20000), (1200000)) AS x(shift)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    sql = ORACLES["t16_t17_format"].replace("FROM part)", f"FROM '{tmp_path}/part.parquet')")
    same(QUERIES["t16_t17_format"](spark, str(tmp_path)), sql)


def test_file_names(spark):
    assert one(spark, cascade.file_name_keyword(F.col("x"), ReviewConfig().keywords), x="board_Confidential-minutes.docx")
    assert not one(spark, cascade.file_name_keyword(F.col("x"), ReviewConfig().keywords), x="confidentially.docx")


def test_file_cascade_ranks_copies_among_survivors(spark):
    rows = [(1, "a.txt", ".txt", "vera confidential plan", 10, False), (2, "b.txt", ".txt", "vera confidential plan", 10, False), (3, "c.txt", ".txt", "Vera writes a report", 9, False), (4, "d.txt", ".txt", "vera WRITES a report!", 9, False), (5, "e.bin", ".bin", "vera", 4, False), (6, "f.txt", ".txt", "nobody", 6, False), (7, "g.txt", ".txt", "vera", 4, True), (8, "h.txt", ".txt", "vera", 4, False), (9, "i.txt", ".txt", "vera", 4, False)]
    df = spark.createDataFrame(rows, "id long, name string, ext string, text string, bytes long, protected boolean")
    got = {r.id: r.rule for r in cascade.file_cascade(df, ReviewConfig(subject=PERSON)).collect()}
    assert got == {1: "keyword", 2: "keyword", 3: "files_filter", 4: "dup", 5: "unsupported_type", 6: "subject_absent", 7: "password", 8: "files_filter", 9: "files_filter"}
    client = {r.id: r.rule for r in cascade.file_cascade(df, ReviewConfig(subject=PERSON, client_case=True)).collect()}
    assert client[1] == "files_filter" and client[2] == "dup" and client[6] == "files_filter"


def test_mail_cascade(spark):
    rows = [
        (1, "a@x", ["b@x"], "hi vera", "t", True), (2, "a@x", ["b@x"], "vera", "privileged", False), (3, "a@x", ["vo@home.example"], "vera", "privileged", False),
        (4, "vera.olin@work.example", ["vo@home.example"], "s", "b", False), (5, "", ["b@x"], "vera", "b", False), (6, "a@x", ["b@x"], "s", "b", False), (7, "a@x", ["b@x"], "s", "for Vera", False),
    ]
    df = spark.createDataFrame(rows, "id long, sender string, recipients array<string>, subject string, body string, is_duplicate boolean").withColumn("attachment_names", F.expr("CAST(array() AS ARRAY<STRING>)"))
    got = {r.id: (r.state, r.rule) for r in cascade.mail_cascade(df, ReviewConfig(subject=PERSON)).collect()}
    assert got == {1: ("discarded", "dup"), 2: ("discarded", "keyword"), 3: ("pending", None), 4: ("review", "self_forward"), 5: ("discarded", "draft"), 6: ("discarded", "subject_absent"), 7: ("pending", None)}


def test_excerpts_touching_windows_join(spark):
    df = spark.createDataFrame([("c", i, "vera" if i in (5, 8, 20) else "x") for i in range(24)], "chat string, seq int, text string")
    got = [(r["first"], r["last"], r.n_candidates) for r in chat.excerpts(df, F.col("text") == "vera", 2).orderBy("first").collect()]
    assert got == [(3, 10, 2), (18, 22, 1)]


@pytest.mark.parametrize(("name", "w", "h", "n", "inline", "want"), [("a.png", 1, 900, 90_000, False, "signature"), ("a.png", 64, 60, 90_000, False, "signature"), ("a.jpg", 900, 900, 4_999, False, "signature"), ("a.jpg", 800, 160, 9_000, False, "signature"), ("logo.png", 300, 300, 9_000, False, "signature"), ("a.jpg", 700, 700, 9_000, False, "content"), ("a.jpg", 700, 700, 9_000, True, "ambiguous"), ("x/logo-2.png", 900, 900, 200_000, False, "ambiguous"), ("a.jpg", 300, 300, 9_000, False, "ambiguous")])
def test_image_classes(spark, name, w, h, n, inline, want):
    assert one(spark, images.classify(*map(F.col, ("a", "b", "c", "d", "e"))), a=name, b=w, c=h, d=n, e=inline) == want


def test_funnel_and_outcomes_add_up(spark):
    groups = spark.createDataFrame([("discarded", "dup", 10, "files"), ("discarded", "keyword", 5, "files"), ("kept", "ai_file", 3, "files"), ("review", "ai_file", 2, "files"), ("pending", None, 4, "files"), ("discarded", "odd", 1, "files")], "state string, rule string, count long, kind string")
    f = insights.funnel(groups).first()
    assert (f.received, f.after_duplicates, f.after_subject, f.ai_kept, f.ai_waiting, f.removed_percent, f.kept_percent) == (25, 15, 10, 3, 5, 60, 50)
    bars = insights.outcome_bars(groups).collect()
    assert sum(r.n for r in bars) == bars[0].unique == 15


def test_change_log_is_idempotent(spark):
    e = spark.createDataFrame([(1, i, s, None) for i, s in enumerate(["kept", "kept", "review", "review", "kept"])], "item_id long, at long, state string, rule string")
    log = ledger.changes(e, "item_id", ["at"], ("state", "rule"))
    assert sorted(r.at for r in log.collect()) == [0, 2, 4]
    assert ledger.append_changes(log, e.filter("at = 4"), "item_id", ["at"], ("state", "rule")).count() == 0
    assert ledger.append_changes(log, e.filter("at = 3"), "item_id", ["at"], ("state", "rule")).count() == 1


def test_null_keys_are_no_duplicates(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "k"), (4, "k")], "id long, k string")
    assert {r.id for r in dedup.mark_duplicates(df, ["k"], ["id"]).filter("is_duplicate").collect()} == {4}


def test_numbers_follow_the_ledger(spark):
    df = spark.createDataFrame([(i, "r") for i in range(1, 6)], "id long, request string")
    old = spark.createDataFrame([(2, "r", 1), (4, "r", 2)], "id long, request string, n int")
    got = {r.id: r.number for r in numbering.number_with_ledger(df, old, "id", ["request"], ["id"]).collect()}
    assert got == {2: 1, 4: 2, 1: 3, 3: 4, 5: 5}


def test_natural_order(spark):
    names = ["b10", "b9", "a2x10", "a2x9", "a"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(T.natural_key(F.col("n"))).collect()] == ["a", "a2x9", "a2x10", "b9", "b10"]


def test_backoff(spark):
    assert [one(spark, jobs.backoff_seconds(F.col("x")), x=n) for n in (1, 2, 7, 9)] == [5, 10, 300, 300]


def test_answers(spark):
    good = '```json\n{"relevance": "relevant", "sensitivity": "none", "reason": "r", "confidence": 80}\n```'
    assert one(spark, verdicts.parse_answer(F.col("x")), x=good).confidence == 80
    assert one(spark, verdicts.parse_answer(F.col("x")), x='{"relevance": "maybe", "sensitivity": "none"}') is None
    assert one(spark, verdicts.parse_answer(F.col("x")), x="no json") is None


def test_column_pages(spark):
    assert one(spark, sheets.column_pages(F.array(*map(F.lit, (100, 40, 1, 200, 5)))), x=0) == [1, 1, 2, 3, 4]


def test_mail_parser_goes_into_attached_mail(spark):
    inner = b"From: i@x\r\nTo: j@x\r\nSubject: inner\r\nMessage-ID: <i>\r\n\r\nin"
    outer = b"From: a@x\r\nTo: b@x, c@x\r\nSubject: outer\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=Q\r\n\r\n--Q\r\nContent-Type: text/plain\r\n\r\nout\r\n--Q\r\nContent-Type: message/rfc822\r\n\r\n" + inner + b"\r\n--Q\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=a.pdf\r\n\r\nPDF\r\n--Q--\r\n"
    df = spark.createDataFrame([("m.eml", bytearray(outer)), ("n.eml", None)], "path string, content binary")
    rows = parsers.parse_mail(df).orderBy("depth").collect()
    assert [(r.subject, r.depth, r.parent) for r in rows] == [("outer", 0, None), ("inner", 1, "m.eml")]
    assert rows[0].recipients == ["b@x", "c@x"] and [a.filename for a in rows[0].attachments] == ["a.pdf"]


def test_archives(spark):
    def zipped(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, data in files.items():
                z.writestr(n, data)
        return out.getvalue()

    nested = zipped({"a.txt": b"1", "in.zip": zipped({"b.txt": b"2"})})
    df = spark.createDataFrame([("x.zip", bytearray(nested)), ("bad.zip", bytearray(b"PK no"))], "path string, content binary")
    got = {(r.path, r.state) for r in parsers.expand_archives(df).collect()}
    assert got == {("x.zip/a.txt", "kept"), ("x.zip/in.zip/b.txt", "kept"), ("bad.zip", "zip_error")}
    assert one(spark, parsers.protected(F.col("x")), x=bytearray(b"PK\x03\x04\x14\x00\x01\x00")) is True
    assert one(spark, parsers.protected(F.col("x")), x=bytearray(nested)) is False


def test_scans(spark, tmp_path):
    (tmp_path / "c/r/Files").mkdir(parents=True)
    (tmp_path / "c/r/Files/a.txt").write_text("1")
    (tmp_path / "c/r/Files/.h").write_text("1")
    (tmp_path / "l.jsonl").write_text('{"h": "x", "n": 1}\n{"h": "y", "skip": true}\n{"h": "z')
    listing = scans.files(spark, str(tmp_path / "c"))
    assert scans.folder_summary(listing).first().n_files == 1
    assert {r.h for r in scans.ledger(spark, str(tmp_path / "l.jsonl")).collect()} == {"x", "y"}


def test_sheet_body(spark):
    html = '<head><title>x</title></head><div style="display:none">pre</div><p>One &amp; two</p><p>three<br/>four&zwnj;</p><span hidden>no</span>'
    assert one(spark, T.sheet_body(F.col("x")), x=html) == "One & two\nthree\nfour"


def test_sample_keeps_later_mentions(spark):
    text = "h" * 30 + "\n" + "\n".join(["x" * 9, "has Vera", "vera again", "z" * 50])
    assert one(spark, T.sample(F.col("x"), ["vera"], 50, 30, 5, 8), x=text) == "h" * 30 + "\n…\nhas Vera\nvera aga"
    assert one(spark, T.sample(F.col("x"), ["vera"], 500, 30, 5, 8), x=text) == text


def test_pictures_and_unreadable_files(spark):
    rows = [
        (1, "a.png", ".png", None, 90_000, False, 800, 600, None, None), (2, "b.png", ".png", None, 90_000, False, None, None, None, None), (3, "logo.png", ".png", None, 9_000, False, 300, 90, None, None),
        (4, "c.png", ".png", None, 90_000, False, 500, 400, "decoration", None), (5, "d.png", ".png", None, 90_000, False, 800, 600, None, "discard"), (6, "e.pdf", ".pdf", None, 9, False, None, None, None, None),
        (7, "f.xlsx", ".xlsx", "nobody", 9, False, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id long, name string, ext string, text string, bytes long, protected boolean, width int, height int, vision string, picture_verdict string")
    got = {r.id: (r.state, r.rule, r.decided_by) for r in cascade.file_cascade(df, ReviewConfig(subject=PERSON)).collect()}
    assert got[1] == got[6] == ("kept", "files_filter", "rule") and got[2][1] == "unreadable_image" and got[3][1] == got[4][1] == "signature_image"
    assert got[5] == ("discarded", "ai_file", "judge") and got[7][1] == "subject_absent"
    client = {r.id: r.rule for r in cascade.file_cascade(df, ReviewConfig(subject=PERSON, client_case=True)).collect()}
    assert client[7] == "subject_absent" and client[6] == "files_filter"


def test_byte_copies_count_against_kept_files(spark):
    rows = [(1, "a.mp4", ".mp4", "", 9, False, "h"), (2, "b.txt", ".txt", "vera wrote this", 9, False, "h"), (3, "c.mp4", ".mp4", "", 9, False, "h"), (4, "d.txt", ".txt", "vera", 9, True, "h")]
    df = spark.createDataFrame(rows, "id long, name string, ext string, text string, bytes long, protected boolean, content_hash string")
    assert {r.id: r.rule for r in cascade.file_cascade(df, ReviewConfig(subject=PERSON)).collect()} == {1: "unsupported_type", 2: "files_filter", 3: "dup", 4: "password"}


def test_confidential_mail_never_stays(spark):
    fold = lambda v, s, p: tuple(one(spark, verdicts.fold_mail(F.col("v"), F.col("s"), F.lit("r"), F.col("p")), v=v, s=s, p=p))
    assert fold("keep", "legal_privileged", True) == ("discard", "Confidential (legal_privileged): r", False, True)
    assert fold("keep", "made_up", False) == ("keep", "r", False, False) and fold("discard", "none", True) == ("discard", "r", True, False)


def test_workbooks_differ_by_place(spark):
    def key(*cells):
        df = spark.createDataFrame([("b", *c) for c in cells], "book string, sheet string, row int, col int, value string")
        return dedup.workbook_key(df, ["book"]).first().content_key

    one_ = key(("S", 1, 1, "a"), ("S", 1, 2, "b"))
    assert one_ == key(("S", 1, 2, " b "), ("S", 1, 1, "a​"), ("S", 2, 1, "  "))
    assert len({one_, key(("S", 1, 1, "b"), ("S", 1, 2, "a")), key(("T", 1, 1, "a"), ("S", 1, 2, "b")), key(("S", 1, 1, "a|b"))}) == 4


def test_broken_entries_and_names_of_archives(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("good.txt", b"1")
        z.writestr("bad.txt", b"content that will be damaged")
        z.writestr("../evil.txt", b"2")
        z.writestr("Comitê.txt", b"3")
    raw = bytearray(out.getvalue())
    raw[raw.index(b"content that")] ^= 1
    df = spark.createDataFrame([("x.zip", raw)], "path string, content binary")
    got = {r.path: r.state for r in parsers.expand_archives(df).collect()}
    assert got == {"x.zip/good.txt": "kept", "x.zip/bad.txt": "zip_error", "x.zip/../evil.txt": "unsafe_path", "x.zip/Comitê.txt": "kept"}
    assert len(parsers.safe_path("a/" + "x" * 300 + ".txt").split("/")[1].encode()) <= 240 and parsers.safe_path("/etc/x") is None


def test_password_marks(spark):
    import struct

    def ole(name, data):
        sector = lambda b: b + bytes(512 - len(b))
        entry = lambda n, kind, first, size: (n.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HB", len(n) * 2 + 2, kind) + bytes(49) + struct.pack("<IQ", first, size)
        head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(22) + struct.pack("<H", 9) + bytes(16) + struct.pack("<I", 1) + bytes(4) + struct.pack("<I", 64) + bytes(16) + struct.pack("<I", 0) + b"\xff" * 432
        fat = struct.pack("<3I", 0xFFFFFFFD, 0xFFFFFFFE, 0xFFFFFFFE) + b"\xff" * 500
        return sector(head[:512]) + fat + sector(entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry(name, 2, 2, max(64, len(data)))) + sector(data)

    rar5 = b"Rar!\x1a\x07\x01\x00" + bytes(4) + bytes([2, 4, 0])
    rar4 = b"Rar!\x1a\x07\x00" + struct.pack("<HBHH", 0, 0x73, 0x80, 13) + bytes(6)
    seven = b"7z\xbc\xaf\x27\x1c" + bytes(6) + struct.pack("<QQ", 0, 8) + bytes(4) + b"..\x06\xf1\x07\x01.."
    yes = [ole("EncryptedPackage", b"x"), ole("WordDocument", bytes(10) + b"\x00\x01"), ole("Workbook", struct.pack("<HH", 0x809, 4) + bytes(4) + struct.pack("<HH", 0x2F, 2) + bytes(2)), rar5, rar4, seven]
    no = [ole("WordDocument", bytes(12)), ole("Workbook", struct.pack("<HH", 0x809, 4) + bytes(4) + struct.pack("<HH", 0x0A, 0)), rar5[:8], b"plain text", b""]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(yes + no)], "i int, content binary")
    got = {r.i: r.p for r in df.select("i", parsers.protected("content").alias("p")).collect()}
    assert [got[i] for i in range(len(yes + no))] == [True] * len(yes) + [False] * len(no)


def test_mail_nested_deep_is_all_there(spark):
    raw = b"Subject: 30\r\n\r\nend"
    for i in reversed(range(30)):
        raw = b"Subject: %d\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=Q%d\r\n\r\n--Q%d\r\nContent-Type: message/rfc822\r\n\r\n%s\r\n--Q%d--\r\n" % (i, i, i, raw, i)
    df = spark.createDataFrame([("m.eml", bytearray(raw))], "path string, content binary")
    assert [r.subject for r in parsers.parse_mail(df).orderBy("depth").collect()] == [str(i) for i in range(31)]


def test_snapshots_are_emitted_when_they_change(spark, tmp_path):
    from sievetide.streaming import feeds

    seen = []
    for i, v in enumerate((1, 0, 2)):  # the second file changes nothing that the aggregate shows
        spark.createDataFrame([(v,)], "v long").write.parquet(str(tmp_path / f"in/p{i}"))
    stream = spark.readStream.schema("v long").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    feed = feeds.snapshot_feed(stream, lambda s: s.agg(F.sum("v").alias("total")), lambda df, epoch: seen.append(df.first().total), seconds=None)
    feed.awaitTermination()
    assert seen[-1] == 3 and all(a != b for a, b in zip(seen, seen[1:], strict=False))


def test_the_rest_lives_without_training_data(tmp_path):
    """On a copy without the subpackage llm and the pipeline's operators, the entry has all other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    shutil.copytree(root / "sievetide", tmp_path / "sievetide", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 140 and set(o) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
