"""Object-audio files written here, read back as tables."""

import struct

import pytest

from soundtable.operators import profile, session
from soundtable.sources import adm


def chunk(name, body, size=None):
    return name + struct.pack("<I", len(body) if size is None else size) + body + b"\0" * (len(body) % 2)


def fmt(channels, rate=48000, bits=24):
    return chunk(b"fmt ", struct.pack("<HHIIHH", 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits))


def chna(tracks, refs):
    return chunk(b"chna", struct.pack("<HH", tracks, len(refs)) + b"".join(struct.pack("<H12s14s11sx", i + 1, f"ATU_{i:08x}".encode(), b"AT_00031001_01", ref) for i, ref in enumerate(refs)))


AXML = """<audioFormatExtended version="ITU-R_BS.2076-2"><audioProgramme audioProgrammeID="APR_1001" audioProgrammeName="Show">
<audioObject audioObjectName="Voice" importance="0"><audioChannelFormat audioChannelFormatName="V" typeDefinition="Objects"><audioBlockFormat rtime="0"><cartesian>1</cartesian>
<jumpPosition interpolationLength="0">1</jumpPosition></audioBlockFormat><audioBlockFormat rtime="1"><cartesian>1</cartesian><jumpPosition interpolationLength="0.005208">1</jumpPosition></audioBlockFormat></audioChannelFormat></audioFormatExtended>"""


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("masters")
    refs = [b"AP_00010003"] * 6 + [b"AP_00031001"]
    whole = fmt(7) + chunk(b"data", b"\0" * 21 * 5) + chna(7, refs) + chunk(b"axml", AXML.encode())
    made = {
        "good.wav": b"RIFF" + struct.pack("<I", 4 + len(whole)) + b"WAVE" + whole,
        # The samples of more than 4 GB are said to lie before the metadata, which the file then does not reach.
        "long.wav": b"BW64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + chunk(b"ds64", struct.pack("<QQQI", 0, 21 * 2**32, 2**32, 0)) + fmt(7) + chna(3, refs[:3]) + chunk(b"axml", b"") + chunk(b"data", b"", 0xFFFFFFFF),
        "cut.wav": b"RF64" + struct.pack("<I", 0) + b"WAVE" + fmt(2)[:-3],
        "cutmeta.wav": b"RIFF" + struct.pack("<I", 0) + b"WAVE" + fmt(1) + chunk(b"axml", b"<audioObject  ", 500),
        "other.wav": b"RIFX" + b"\0" * 20,
        "wave.wav": b"RIFF\0\0\0\0AVI " + b"\0" * 20,
        "tiny.wav": b"RIFF",
        "none.wav": b"",
        "odd.wav": b"RIFF\0\0\0\0WAVE" + chunk(b"LIST", b"abc") + chunk(b"dbmd", b"x") + whole,
    }
    for name, data in made.items():
        (folder / name).write_bytes(data)
    # A file of which only the ends are there: the samples take no room on disk and are not read.
    with open(folder / "sparse.wav", "wb") as f:
        f.write(b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + chunk(b"ds64", struct.pack("<QQQI", 0, 5 * 2**30, 0, 0)) + fmt(1) + b"data" + struct.pack("<I", 0xFFFFFFFF))
        f.seek(5 * 2**30, 1)
        f.write(chna(1, [b"AP_00031001"]) + chunk(b"axml", AXML.encode()))
    return adm.read_adm_corpus(spark, str(folder)).cache()


def by_name(rows):
    return {r.path.rsplit("/", 1)[1]: r for r in rows.collect()}


def test_files(files):
    got = by_name(files)
    assert {n: r.error for n, r in got.items() if r.error} == {"other.wav": "not_riff", "wave.wav": "not_wave", "tiny.wav": "too_small"}
    good = got["good.wav"]
    assert (good.container, good.is_adm, good.channels, good.rate, good.bits, good.frames, good.warnings) == ("RIFF/WAVE", True, 7, 48000, 24, 5, [])
    assert [(c.id, int(c.size)) for c in good.chunks] == [("fmt ", 16), ("data", 105), ("chna", 4 + 280), ("axml", len(AXML))] and good.axml == AXML
    assert (good.tracks, good.uids[6].track_index, good.uids[6].uid, good.uids[6].pack_ref) == (7, 7, "ATU_00000006", "AP_00031001")
    long = got["long.wav"]
    assert (long.container, long.frames, long.is_adm, long.axml) == ("BW64", 2**32, True, "") and long.warnings == ["chna tracks differ from fmt channels"]
    assert got["cut.wav"].warnings == ["missing data chunk", "missing chna chunk", "missing axml chunk"] and got["cut.wav"].channels == 2
    assert got["cutmeta.wav"].axml == "<audioObject  " and not got["cutmeta.wav"].is_adm
    assert [c.id for c in got["odd.wav"].chunks] == ["LIST", "dbmd", "fmt ", "data", "chna", "axml"]
    sparse = got["sparse.wav"]
    assert (sparse.frames, sparse.axml, len(sparse.uids)) == (5 * 2**30 // 3, AXML, 1)


def test_tables_of_files(spark, files):
    uids, chunks = adm.track_uids(files), adm.file_chunks(files)
    assert uids.count() == 7 + 3 + 7 + 1
    assert {n: (r.type1, r.type3, r.common, r.other) for n, r in by_name(session.pack_census(uids, "path", "pack_ref")).items()} == {"good.wav": (1, 1, 1, 0), "odd.wav": (1, 1, 1, 0), "long.wav": (1, 0, 1, 0), "sparse.wav": (0, 1, 0, 0)}
    codes = {}
    for r in profile.profile_check(files, uids).collect():
        codes.setdefault(r.path.rsplit("/", 1)[1], set()).add(r.code)
    assert "good.wav" not in codes and "odd.wav" not in codes and "sparse.wav" not in codes
    assert codes["cut.wav"] == codes["tiny.wav"] == codes["cutmeta.wav"] == {"not_adm"}
    assert "bed_layout" not in codes.get("long.wav", ())  # three tracks of a pack that the profile has
    assert {r.path.rsplit("/", 1)[1] for r in profile.ingest_advisory(files, chunks).collect()} == {"good.wav", "sparse.wav"}
    formats = {n: (r.name, r.type, r.blocks, r.coordinate) for n, r in by_name(adm.channel_formats(files)).items()}
    assert formats == {n: ("V", "Objects", 2, "cartesian") for n in ("good.wav", "odd.wav", "sparse.wav")}
    counts = by_name(adm.metadata_counts(files))
    assert set(counts) == {"good.wav", "odd.wav", "sparse.wav", "cutmeta.wav"} and (counts["good.wav"].version, counts["good.wav"].programme, counts["good.wav"].importance) == ("ITU-R_BS.2076-2", "Show", [0])


def test_profile_of_nulls(spark):
    files = spark.createDataFrame([("a", None, None, None, None, None), ("b", True, None, None, None, None)], "path string, is_adm boolean, rate int, bits int, channels int, axml string")
    uids = spark.createDataFrame([("b", None), ("b", "AP_00010009"), (None, "AP_00040001")], "path string, pack_ref string")
    got = sorted((r.path, r.code) for r in profile.profile_check(files, uids).collect())
    assert got == [("a", "not_adm"), ("b", "bed_layout"), ("b", "bit_depth"), ("b", "sample_rate")]
