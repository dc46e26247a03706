import datetime
import hashlib

import pytest

from threadloom.llm import privacy as pv


def kinds(text):
    return sorted({k for _, _, k in pv.formats(pv.readable(text))})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to a.b+x@corp.test. Then", ["email"]), ("是a@team.example.net，", ["email"]), ("a_b [at] uni [dot] test", ["email"]), ("x at uni dot test", ["email"]), ("a＠b.cd", ["email"]),
        ("call (467) 555-0165 now", ["phone"]), ("+44 (0)7700 900529", ["phone"]), ("１７９３４５７７６３８", ["phone"]), ("86-14673734534", ["phone"]), ("938.555.0143", ["phone"]),
        ("SSN 935 40 5890", ["id_number"]), ("qq 37 82 66 b", ["id_number"]), ("证件号码：99639819880818861x", ["id_number"]), ("ZV2629624 expires", ["id_number"]),
        ("I moved to 295 marrowby lane, greyfield last week", ["address"]), ("P.O. Box 715, Little Tarn", ["address"]), ("霁州市柳汀区听雨巷153号8栋2002室", ["address"]),
        ("cc Ms Quillby", ["name"]), ("Per Dr. Brinley.", ["name"]),
        ("Meet @ 10:30, room 20B, build 20251117.2.", []), ("Pinned @narforis/core@6.14.6 in", []), ("Epoch 1735666176842 ms", []), ("417 message brokers, Apt build included", []),
        ("Latency went from 441.128 to 96.660 over 9,964,445 calls.", []), ("0x55a216bad5e7 was freed", []), ("NI no: XXXXXXXXX", []), ("", []), ("street-level view, home address form", []),
    ],
)
def test_formats(text, want):
    assert kinds(text) == want


def table(spark, contents):
    at = datetime.datetime(2025, 1, 1)
    rows = [(i, f"e{i}", at, c, hashlib.sha256((c or "").encode()).hexdigest(), "clash") for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "delivery_id bigint, event_id string, received_at timestamp, content string, content_hash string, types string")


FILLER = ["The log sampler only made sense while the api gateway was small.", "Spoke with the vendor about it.", "Thovith Notebook signed off yesterday."] * 40


def test_names_are_told_by_what_the_corpus_discloses(spark):
    contents = [*FILLER, "mail hesper.sorvik@uni.test or Ms Sorvik", "mail corin.brackle@uni.test", "Half of this is from hesper sorvik, the rest is mine.", "Nobody told Brackle, Corin about it.", "Spoke with Corin B. about it.", None, "", "x" * 200_000]
    n = len(FILLER)
    got = {(r.event_id, r.pii_type) for r in pv.find(table(spark, contents)).collect()}
    assert got == {(f"e{n}", "email"), (f"e{n}", "name"), (f"e{n + 1}", "email"), (f"e{n + 2}", "name"), (f"e{n + 3}", "name"), (f"e{n + 4}", "name")}
    clean = {r.event_id: r.content for r in pv.sanitise(table(spark, contents).select("event_id", "content"), "event_id").collect()}
    assert clean[f"e{n + 2}"] == "Half of this is from [NAME], the rest is mine."
    assert clean[f"e{n}"] == "mail [EMAIL] or [NAME]"
    assert clean["e2"] == FILLER[2] and clean[f"e{n + 5}"] is None


def test_without_disclosure_nothing_stands(spark):
    contents = [*FILLER, "mail hesper.sorvik@uni.test or Ms Sorvik", "Half of this is from hesper sorvik.", "Call me on 020 7946 0733 after six", "\u8d1f\u8d23\u4eba\uff1a\u891a\u660e\u8fdc"]
    assert pv.find(table(spark, contents), threshold=1000.0).count() == 0
    assert pv.find(table(spark, contents)).count() >= 4


ZH = ["\u4eca\u5929\u5148\u6574\u7406\u65e5\u5fd7\uff0c\u660e\u5929\u518d\u770b\u7f13\u5b58\u3002", "\u8fdc\u7a0b\u90e8\u7f72\u811a\u672c\u5931\u8d25\uff0c\u8bf7\u8054\u7cfb\u8fd0\u7ef4\u3002", "\u6211\u4eec\u51b3\u5b9a\u5148\u5904\u7406\u6587\u6863\u3002"] * 60


def test_chinese_names_need_no_list(spark):
    contents = [*ZH, "\u8d1f\u8d23\u4eba\uff1a\u891a\u660e\u6770", "\u8054\u7cfb\u4eba: \u536b\u660e\u6770", "\u8d1f\u8d23\u4eba\uff1a\u891a\u4f1f", "\u8bf7\u8054\u7cfb\u891a\u660e\u8fdc\u5148\u751f\u3002", "\u662f\u536b\u4f1f\u5b9a\u7684\u3002", "\u662f\u891a\u660e\u6770\u8bf4\u7684\u3002"]
    n = len(ZH)
    got = {(r.event_id, r.pii_type) for r in pv.find(table(spark, contents)).collect()}
    assert got == {(f"e{n + i}", "name") for i in range(6)}
    clean = {r.event_id: r.content for r in pv.sanitise(table(spark, contents).select("event_id", "content"), "event_id").collect()}
    assert clean[f"e{n + 3}"] == "\u8bf7\u8054\u7cfb[NAME]\u3002" and clean[f"e{n + 5}"] == "\u662f[NAME]\u8bf4\u7684\u3002"
    assert all(clean[f"e{i}"] == c for i, c in enumerate(ZH))


def test_what_is_not_replaced_stays_as_it_was(spark):
    odd = "\u4f60\u597d\uff0c\u4e16\u754c\uff08\u6d4b\u8bd5\uff09\uff1a\u2460\u00bd \ufb01le"
    contents = [*FILLER, odd, odd + " mail \uff41\uff20b.cd " + odd]
    clean = {r.event_id: r.content for r in pv.sanitise(table(spark, contents).select("event_id", "content"), "event_id").collect()}
    assert clean[f"e{len(FILLER)}"] == odd and clean[f"e{len(FILLER) + 1}"] == odd + " mail [EMAIL] " + odd


def test_the_list_of_harmless_words_changes_nothing(spark, monkeypatch):
    contents = [*FILLER, "mail hesper.sorvik@uni.test", "Half of this is from hesper sorvik, the rest is mine.", "Spoke with Hesper Quill about it."]
    want = {(r.event_id, r.pii_type) for r in pv.find(table(spark, contents)).collect()}
    real = pv._known
    monkeypatch.setattr(pv, "_known", lambda statistics, threshold: real(statistics, threshold, 1))
    assert {(r.event_id, r.pii_type) for r in pv.find(table(spark, contents)).collect()} == want


def test_only_the_kept_copy_counts(spark):
    at = datetime.datetime(2025, 1, 1)
    rows = [(1, "A", at, "mail a@b.cd", "0" * 64), (2, "a ", at, "nothing", hashlib.sha256(b"nothing").hexdigest())]
    df = spark.createDataFrame(rows, "delivery_id bigint, event_id string, received_at timestamp, content string, content_hash string")
    assert pv.find(df).count() == 0


def test_empty_table(spark):
    assert pv.find(table(spark, [])).count() == 0
