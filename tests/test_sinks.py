"""Files on disk: reading archives, extraction, ZIP files, reports and arriving archives."""

import glob
import json
import os
import zipfile
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assetspark.functions import compression as Z
from assetspark.operators import export
from assetspark.operators.catalog import entries, highlighted
from assetspark.plans import pictures
from assetspark.sources import archive as A
from assetspark.sources import sink
from assetspark.sources.bom import Store, StoreError
from assetspark.sources.reader import Catalog
from assetspark.streaming import arrivals

TAGS = [17, 12]


def gray(name, w, h, pixels, tlvs=b"", layout=12):
    return A.encode_rendition(w, h, 100, "GRAY", layout, name, tlvs, A.encode_raster(0, pixels))


@pytest.fixture(scope="module")
def made():
    reference = A.encode_reference((1, 1, 2, 1), 12, [(17, 1), (12, 1)])
    facets = [("Icon", [(17, 1)]), ("Tint", [(17, 2)]), ("Sizes", [(17, 3)]), ("Data", [(17, 4)]), ("Link", [(17, 5)]), ("Bad", [(17, 6)]), ("Evil", [(17, 7)]), ("Lost", [(17, 8)])]
    renditions = [
        ([1, 1], gray("icon.png", 4, 2, bytes(range(8)))),
        ([2, 1], A.encode_rendition(0, 0, 100, "None", 1009, "tint", b"", A.encode_color(3, [0.5, 0.25, 1.0, 1.0]))),
        ([3, 2], A.encode_rendition(0, 0, 200, "None", 1010, "sizes", b"", A.encode_sizes([(16, 16, 0, 1), (32, 32, 1, 9)]))),
        ([4, 1], A.encode_rendition(0, 0, 100, "DATA", 1000, "notes.txt", b"", A.encode_raw(Z.lzfse_vn(b"some notes")))),
        ([5, 1], A.encode_rendition(2, 1, 100, "GRAY", 1003, "link.png", reference, b"")),
        ([6, 1], A.encode_rendition(4, 2, 100, "GRAY", 12, "bad.png", b"", A.encode_raster(1, b"?"))),
        ([7, 1], gray("../evil.png", 4, 2, bytes(8))),
        ([8, 1], A.encode_rendition(0, 0, 100, "None", 12, "lost", b"", b"")),
    ]
    return A.encode(TAGS, facets, renditions)


@pytest.fixture
def folder(made, tmp_path):
    top = tmp_path / "in"
    top.mkdir()
    (top / "Assets.car").write_bytes(made)
    return str(top)


def test_archives_on_disk(spark, folder, made):
    catalog = Catalog.open(spark, f"{folder}/*.car")
    assert catalog.facets.count() == 8 and catalog.renditions.count() == 8 and entries(catalog).count() == 8
    assert catalog.errors.count() == 0 and catalog.renditions.where("raw IS NOT NULL").count() == 0
    assert catalog.payloads.where("rendition_name = 'notes.txt'").first().raw == Z.lzfse_vn(b"some notes")
    with open(f"{folder}/cut.car", "wb") as f:
        f.write(made[:-40])
    with open(f"{folder}/other.car", "wb") as f:
        f.write(b"nothing of the kind")
    both = Catalog.open(spark, f"{folder}/*.car")
    assert {r.archive_id.rpartition("/")[2] for r in both.errors.collect()} == {"cut.car", "other.car"} and both.facets.count() == 8
    catalog.close(), both.close()


@pytest.mark.parametrize("at", range(8, 32, 4))
def test_bad_stores(made, at):
    broken = made[:at] + b"\xff\xff\xff\xff" + made[at + 4 :]
    if at in (8, 12):  # version and count are not looked at
        assert Store(broken).named("CARHEADER")[:4] == b"RATC"
        return
    with pytest.raises((StoreError, Exception)):
        A.parse(broken)


def test_extraction(spark, folder, tmp_path):
    catalog, root = Catalog.open(spark, folder), str(tmp_path / "out")
    rows = {r.asset_id: r for r in sink.extract(catalog, root).collect()}
    files = {os.path.relpath(p, root): open(p, "rb").read() for p in glob.glob(f"{root}/**/*", recursive=True) if os.path.isfile(p)}
    assert set(files) == {f"Assets/{p}" for p in ("Icon/icon.png", "Tint/tint.json", "Sizes/sizes@2x.json", "Data/notes.txt", "Link/link.png")}
    assert files["Assets/Data/notes.txt"] == b"some notes"
    assert json.loads(files["Assets/Tint/tint.json"]) == {"colorSpace": "display-p3", "components": [0.5, 0.25, 1.0, 1.0]}
    assert json.loads(files["Assets/Sizes/sizes@2x.json"]) == [{"height": 16, "idiom": "phone", "index": 0, "width": 16}, {"height": 32, "idiom": "unknown", "index": 1, "width": 32}]
    pixels = lambda b: zlib.decompress(b[b.index(b"IDAT") + 4 : b.index(b"IEND") - 8])
    assert pixels(files["Assets/Icon/icon.png"]) == b"\0" + bytes([0, 1, 2, 3]) + b"\0" + bytes([4, 5, 6, 7])
    assert pixels(files["Assets/Link/link.png"]) == b"\0" + bytes([1, 2])
    outcomes = sorted(((r.outcome, r.error_code) for r in rows.values()), key=str)
    assert outcomes == sorted([("Saved", None)] * 5 + [("Failed", "UnsupportedCompression"), ("Skipped", "UnsafeFileName"), ("Skipped", "UnsupportedPayload")], key=str)
    again = sink.extract(catalog, root)
    assert sink.extract_summary(again).select("saved", "skipped", "failed").first() == (0, 7, 1)
    os.remove(f"{root}/Assets/Icon/icon.png")
    assert sink.extract_summary(sink.extract(catalog, root)).select("saved", "skipped", "failed").first() == (1, 6, 1)
    assert sink.extract_summary(sink.extract(catalog, root, overwrite=True, folder=F.lit("x"))).select("saved", "skipped", "failed").first() == (5, 2, 1)
    assert os.path.exists(f"{root}/x/Icon/icon.png") and not glob.glob(f"{root}/**/*.part-*", recursive=True)


def test_zips_and_reports(spark, folder, tmp_path):
    catalog, root = Catalog.open(spark, folder), str(tmp_path / "zip")
    rows = sink.write_zips(catalog, root).collect()
    with zipfile.ZipFile(f"{root}/Assets-assets.zip") as z:
        assert sorted(z.namelist()) == ["asset.png", "icon.png", "link.png", "notes.txt"]
        assert z.read("notes.txt") == b"some notes" and z.testzip() is None
    assert {r.error_code for r in rows if r.name is None} == {"EntryNotDownloadable", "UnsupportedCompression"}
    sink.write_info(catalog, str(tmp_path / "info"))
    lines = [json.loads(x) for p in glob.glob(f"{tmp_path}/info/archive=Assets/part-*") for x in open(p)]
    assert len(lines) == 9 and lines[0]["CoreUIVersion"] == 971 and [x["Name"] for x in lines[1:]] == sorted(x["Name"] for x in lines[1:])
    link = next(x for x in lines[1:] if x["Name"] == "Link")
    assert link["Layout"] == "InternalReference" and link["Compression"] == "Uncompressed" and "Element" not in link


def test_names():
    taken = set()
    assert [sink.free_name(n, taken) for n in ("a.png", "a.png", "a.png", "a (2).png", "x/y:z", "", ".hid", ".hid", "end.", "end.")] == [
        "a.png", "a (2).png", "a (3).png", "a (2) (2).png", "x_y_z", "asset.bin", ".hid", ".hid (2)", "end.", "end. (2)"]
    assert [sink.zip_name(n) for n in (None, " ", "Assets.car", "a/b.car", ".car")] == ["car-assets.zip", "car-assets.zip", "Assets-assets.zip", "a_b-assets.zip", ".car-assets.zip"]


def test_paths_skip_taken_names(spark):
    import random

    rng = random.Random(3)
    names = ["f/asset.png", "f/asset_1.png", "f/asset_2.png", "f/asset", "f/asset_1", "g/asset.png", "f/.x", "f/asset_1_1.png"]
    rows = [(f"a{k % 3}", k, rng.choice(names), rng.random() < 0.9) for k in range(150)] + [("z", k, "h/asset.png", True) for k in range(3)]
    made = spark.createDataFrame(rows, "archive_id string, asset_id long, base_path string, live boolean").repartition(4)
    got = {(r.archive_id, r.asset_id): r.path for r in export.unique_paths(made, F.col("live")).collect()}
    taken, counts = set(), {}
    for a, k, base, live in rows:
        path = base if live else None
        while live and (a, path) in taken:
            counts[a, base] = counts.get((a, base), 0) + 1
            folder, _, name = base.rpartition("/")
            stem, dot, ext = name.rpartition(".")
            path = f"{folder}/{stem}_{counts[a, base]}.{ext}" if stem and dot else f"{base}_{counts[a, base]}"
        taken.add((a, path))
        assert got[a, k] == path
    assert [got["z", k] for k in range(3)] == ["h/asset.png", "h/asset_1.png", "h/asset_2.png"]


def test_highlight_is_literal(spark):
    df = spark.createDataFrame([("a.b A.B axb $1",)], "t string")
    assert df.select(highlighted(F.col("t"), " a.B ")).first()[0] == "[a.b] [A.B] axb $1"
    assert df.select(highlighted(F.col("t"), "$1", "<$", ">")).first()[0] == "a.b A.B axb <$$1>" and df.select(highlighted(F.col("t"), "  ")).first()[0] == "a.b A.B axb $1"


def test_arriving_archives(spark, folder, made, tmp_path):
    target, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    run = lambda: arrivals.follow(spark, folder, lambda c: entries(c).select("archive_id", "asset_id", "facet_name"), target, checkpoint, available_now=True).awaitTermination()
    run()
    assert spark.read.parquet(target).count() == 8
    with open(f"{folder}/More.car", "wb") as f:
        f.write(made)
    run()
    assert spark.read.parquet(target).count() == 16


def test_sample_pictures_can_be_written(spark, tmp_path):
    catalog = Catalog(spark.createDataFrame(pictures._encode(pd.DataFrame({"archive": ["p0"] * 28, "p_partkey": range(28), "p_name": ["x"] * 28}))))
    assert sink.extract_summary(sink.extract(catalog, str(tmp_path / "o"))).select("saved", "failed").first() == (24, 4)
