"""Listings, guards, confined opening and publishing, on real folders."""

import hashlib
import os

import pytest

from annalist.sources import files, publish


@pytest.fixture
def root(tmp_path):
    r = tmp_path / "root"
    (r / "a" / "b").mkdir(parents=True)
    for p, text in (("top.jsonl", "1"), ("a/x.jsonl", "22"), ("a/b/.hidden", "333"), (".mark", "guard")):
        (r / p).write_text(text)
    (tmp_path / "secret").write_text("s")
    (r / "link").symlink_to(tmp_path / "secret")
    (r / "a" / "dir").symlink_to(tmp_path)
    return str(r)


def guard(root, text="guard"):
    return files.Root("active", root, ".mark", hashlib.sha256(text.encode()).hexdigest())


def test_listing_follows_no_link(spark, root):
    got = {(r.root_role, r.path, r.byte_length) for r in files.listed(spark, [guard(root)]).collect()}
    assert got == {("active", "top.jsonl", 1), ("active", "a/x.jsonl", 2), ("active", "a/b/.hidden", 3), ("active", ".mark", 5)}
    assert files.listed(spark, []).count() == 0


def test_guards(root, tmp_path):
    files.check_roots([guard(root)])
    os.symlink(root, tmp_path / "alias")
    for bad in (guard(root, "other"), files.Root("x", str(tmp_path / "none")), files.Root("x", str(tmp_path / "alias")), files.Root("x", str(tmp_path / "secret")), files.Root("x", root, "link", "")):
        with pytest.raises(files.UnhealthyRoot):
            files.check_roots([bad])


def test_opening_stays_below(root):
    with os.fdopen(files.open_beneath(root, "a/x.jsonl")) as f:
        assert f.read() == "22"
    for bad in ("../secret", "a/../top.jsonl", "/etc/passwd", "./top.jsonl", "", "a//x.jsonl"):
        with pytest.raises(ValueError):
            files.open_beneath(root, bad)
    for bad in ("link", "a/dir/secret", "none"):
        with pytest.raises(OSError):
            files.open_beneath(root, bad)


def test_allowlist(spark):
    make = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert {r.path for r in files.allowlist(make("a/b", "c//d", "e/./f")).collect()} == {"a/b", "c/d", "e/f"}
    for bad in ((), ("a/b", "a//b"), ("../a",), ("./a",)):
        with pytest.raises(ValueError):
            files.allowlist(make(*bad))


def test_publish_own_lease_reclaim(root, tmp_path):
    cache = tmp_path / "cache"
    cache.mkdir()
    publish.publish(str(cache / "m.json"), b"{}")
    publish.publish(str(cache / "m.json"), b"[]")
    assert (cache / "m.json").read_bytes() == b"[]" and os.listdir(cache) == ["m.json"]
    with publish.owned(str(cache)), pytest.raises(BlockingIOError), publish.owned(str(cache)):
        pass
    digest = hashlib.sha256(b"22").hexdigest()
    with publish.leased_copy(root, "a/x.jsonl", 2, digest, str(cache)) as p:
        assert open(p).read() == "22" and os.stat(p).st_mode & 0o777 == 0o400
    with pytest.raises(publish.StalePayload), publish.leased_copy(root, "top.jsonl", 2, digest, str(cache)):
        pass
    u = "01234567-89ab-cdef-0123-456789abcdef"
    for n in (f"lease-{digest}-{u}.payload", f".lease-{digest}-{u}.partial", f"lease-{u}.payload"):
        (cache / n).write_text("x")
    assert publish.reclaim(str(cache)) == [f".lease-{digest}-{u}.partial", f"lease-{digest}-{u}.payload"]
    assert sorted(os.listdir(cache)) == [".owner", f"lease-{u}.payload", "m.json"]
