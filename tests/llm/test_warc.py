import base64
import gzip
import hashlib
import io
import random
import tempfile
import tracemalloc

from sparkloom.llm import warc


def folder():
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(rows, least=0):
    """Sorted (id, bytes, digest, kind, refers_to)."""
    lowest = lambda i: -1 if i is None else i
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        top = max((j for j, _, other in rows if (other or "").encode() == data), key=lowest)
        again = len(data) >= least and top != i
        out.append((i, len(data), digest(data), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


def got(chunks):
    rows = warc.records(chunks).select(warc.key_of("record_id").alias("i"), "payload_bytes", "payload_digest", "kind", warc.key_of("refers_to").alias("r"), "fault").collect()
    assert all(r.fault is None for r in rows)
    return sorted((tuple(r)[:5] for r in rows), key=repr)


def pages():
    rng = random.Random(4)
    rows = [(i, f"http://a/{i}", rng.choice(["<p>same</p>", "", None, "é漢" * rng.randint(1, 40), f"own {i}"])) for i in range(80)]
    return [*rows, (None, None, "<p>same</p>"), (None, "http://n", "only null has this"), (200, "http://x\r\nWARC-Type: metadata", "line\r\n\r\nbreaks"), (201, "http://y", "WARC/1.1\r\n\r\n" * 9), (7, "http://again", rows[7][2]), (202, "u", "x" * 1000 + "y" * 5000)]


def framed(spark, rows):
    return spark.createDataFrame([(*r, 9, "clash") for r in rows], "page_id long, url string, html string, bytes int, sha1 string")


def test_same_as_brute_force(spark):
    rows = pages()
    index = warc.write(framed(spark, rows).repartition(3), folder(), chunk=100)
    assert index.count() == len(rows)
    for split, chunk in ((1, 7), (10**9, 64), (2000, 2**18)):
        chunks = warc.read(index, split, chunk)
        assert got(chunks) == brute(rows)
    table = warc.read(index, chunk=7).where("record_id = 'urn:record:202'").collect()
    assert b"".join(r.data for r in sorted(table, key=lambda r: r.chunk)).decode() == rows[-1][2] and max(len(r.data) for r in table) == 7
    assert all(r.digest == digest(rows[-1][2].encode()[: r.bytes]) for r in table)
    assert warc.dangling(warc.records(warc.read(index))).isEmpty()


def test_least_size_and_empty_table(spark):
    rows = pages()
    assert got(warc.read(warc.write(framed(spark, rows), folder(), least=12))) == brute(rows, 12)
    assert warc.read(warc.write(framed(spark, []), folder())).isEmpty()


def test_many_groups_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    rows = pages()
    assert got(warc.read(warc.write(framed(spark, rows), folder()))) == brute(rows)


def test_archives_are_public_format(spark):
    """Each member of an archive is a record that plain gzip unpacks; plain files and several archives are read without an index."""
    rows, place = pages(), folder()
    index = warc.write(framed(spark, rows), place)
    plain = tempfile.mkdtemp(prefix="spark-")
    for n, (name,) in enumerate(index.select("archive").distinct().collect()):
        path = name.removeprefix("file://")
        with open(path, "rb") as f, open(f"{plain}/{n}.warc", "wb") as out:
            whole = gzip.decompress(f.read())
            out.write(whole)
            for r in index.where(f"archive = '{name}'").collect():
                f.seek(r.offset)
                record = gzip.decompress(f.read(r.length))
                assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and f"<{r.record_id}>".encode() in record
    assert got(warc.read_files(spark, place)) == brute(rows) == got(warc.read_files(spark, plain))


def test_broken_archives(spark):
    place = folder()
    index = warc.write(framed(spark, [(1, "u", "abc" * 500)]), place)
    path = index.first().archive.removeprefix("file://")
    whole = gzip.decompress(open(path, "rb").read())
    for name, data in (("cut", whole[:-200]), ("none", b"nothing of the kind\r\n\r\n"), ("wrong", whole.replace(b"abcabc", b"abcabd", 1)), ("member", gzip.compress(whole)[:-30])):
        where = tempfile.mkdtemp(prefix="spark-")
        with open(f"{where}/{name}.warc", "wb") as f:
            f.write(data)
        rows = warc.records(warc.read_files(spark, where)).collect()
        assert len(rows) == 1 and rows[0].fault


def test_a_long_record_takes_a_chunk_of_memory():
    class Zeros(io.RawIOBase):
        """A plain archive with one record of 300 MB, made as it is read."""

        def __init__(self, n):
            self.head = f"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: {n}\r\n\r\n".encode()
            self.size, self.at = n, 0

        def seek(self, at, whence=0):
            self.at = at
            return at

        def read(self, n=-1):
            whole = len(self.head) + self.size + 4
            n = min(n, whole - self.at)
            out = self.head[self.at : self.at + n]
            zeros = min(n - len(out), max(0, len(self.head) + self.size - max(self.at, len(self.head))))
            out += bytes(zeros) + b"\r\n\r\n"[: n - len(out) - zeros] if n > len(out) else b""
            self.at += len(out)
            return out

    n, rows, size = 300 * 2**20, 0, 0
    tracemalloc.start()
    for row in warc.chunks_of("long", Zeros(n)):
        assert row[-1] is None
        rows, size, last = rows + 1, size + len(row[9]), row
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size == n and rows == n // warc.CHUNK and last[12] and last[11] == digest(bytes(n)) and most < 20 * warc.CHUNK
