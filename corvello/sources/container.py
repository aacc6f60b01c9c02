"""Compiled help archives as a Spark data source: list and extract entries, with the compressed section decoded on demand.

``register(spark)`` and ``spark.read.format("corvello_archive").load(path_or_glob)`` give a row
for each entry: path, name, section, offset, length, content.  One archive is one partition.  ``content`` stays null
unless option ``content`` is true, and then only a filter on name decides whether the compressed section is decoded.
That source opens files, so the folder has to be mounted by the driver and all executors; ``read(spark, path)`` gives the
same rows from any file system that Spark reads.  Archives of damaged structure raise ArchiveError with what is wrong.
"""

from __future__ import annotations

import glob
import os
import struct
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

# Fixed values of the archive format.
HEADER, DIRECTORY, LISTING, COMPRESSED = b"ITSF", b"ITSP", b"PMGL", b"LZXC"
STORAGE = "::DataSpace/Storage/MSCompressed/"
FRAME = 0x8000


class ArchiveError(ValueError):
    """An archive whose structure cannot be read."""


@dataclass(frozen=True)
class Entry:
    name: str
    section: int
    offset: int
    length: int


def _number(data: bytes, at: int, kind: str) -> int:
    try:
        return struct.unpack_from(kind, data, at)[0]
    except struct.error:
        raise ArchiveError(f"number at {at} is past the end") from None


def _varint(data: bytes, at: int) -> tuple[int, int]:
    """A number in groups of seven bits, the highest first, and where it ends."""
    value = 0
    while at < len(data):
        value = value << 7 | data[at] & 127
        at += 1
        if data[at - 1] < 128:
            return value, at
    raise ArchiveError("number is past the end")


def varint(value: int) -> bytes:
    out = [value & 127]
    while value := value >> 7:
        out.append(value & 127 | 128)
    return bytes(reversed(out))


class Archive:
    """One archive's directory and contents."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != HEADER:
            raise ArchiveError("no archive")
        self.data, at = data, _number(data, 0x48, "<Q")
        self.base = _number(data, 0x58, "<Q")
        if data[at : at + 4] != DIRECTORY:
            raise ArchiveError("no directory")
        size, n = _number(data, at + 0x10, "<I"), _number(data, at + 0x2C, "<I")
        self.entries: list[Entry] = []
        for start in range(at + 0x54, at + 0x54 + n * size, max(size, 1)):
            page = data[start : start + size]
            if len(page) == size and page[:4] == LISTING:
                self.entries += self._page(page[0x14 : size - _number(page, 4, "<I")])
        self._plain: bytes | None = None

    @staticmethod
    def _page(page: bytes) -> list[Entry]:
        found, at = [], 0
        while at < len(page):
            n, at = _varint(page, at)
            name, at = page[at : at + n].decode("utf-8", "replace"), at + n
            section, at = _varint(page, at)
            offset, at = _varint(page, at)
            length, at = _varint(page, at)
            found.append(Entry(name, section, offset, length))
        return found

    def find(self, name: str) -> Entry:
        for entry in self.entries:
            if entry.name == name:
                return entry
        raise ArchiveError(f"no entry {name}")

    def read(self, entry: Entry) -> bytes:
        part, start = (self.data, self.base) if entry.section == 0 else (self.plain(), 0)
        out = part[start + entry.offset : start + entry.offset + entry.length]
        if len(out) != entry.length:
            raise ArchiveError(f"{entry.name} is past the end of its section")
        return out

    def plain(self) -> bytes:
        """The compressed section, decoded once."""
        if self._plain is None:
            content, control, span = (self.read(self.find(STORAGE + n)) for n in ("Content", "ControlData", "SpanInfo"))
            if control[4:8] != COMPRESSED:
                raise ArchiveError("unknown compression")
            unit = FRAME if _number(control, 8, "<I") == 2 else 1
            reset, window = _number(control, 12, "<I") * unit, _number(control, 16, "<I") * unit
            self._plain = lzx_decode(content, _number(span, 0, "<Q"), reset or 2 * FRAME, max(0, window - 1).bit_length())
        return self._plain


class _Bits:
    """Bits of 16-bit little-endian words, highest first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            word = self.data[self.at : self.at + 2]
            self.held = self.held << 16 | int.from_bytes(word, "little") if len(word) == 2 else self.held << 16
            self.at, self.n = self.at + 2, self.n + 16

    def take(self, n: int) -> int:
        self.need(n)
        self.n -= n
        out = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return out

    def symbol(self, table: _Code) -> int:
        self.need(16)
        symbol, length = table.by_bits[self.held >> (self.n - 16)]
        if not length:
            raise ArchiveError("bits that are no code")
        self.take(length)
        return symbol

    def to_word(self) -> None:
        self.take(self.n % 16)

    def raw(self, n: int) -> bytes:
        """Whole bytes; bits that are held go back first."""
        self.at -= self.n // 8
        self.held = self.n = 0
        out = self.data[self.at : self.at + n]
        self.at += n
        return out.ljust(n, b"\0")


class _Code:
    """Canonical prefix code by lengths: what each 16 bits begin with."""

    def __init__(self, lengths: list[int]) -> None:
        self.by_bits: list[tuple[int, int]] = []
        for length, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
            self.by_bits += [(symbol, length)] * (1 << (16 - length))
        self.by_bits += [(0, 0)] * ((1 << 16) - len(self.by_bits))


def _lengths(bits: _Bits, lengths: list[int], first: int, last: int) -> None:
    """Change lengths first to last - 1 by the differences that are coded next."""
    code = _Code([bits.take(4) for _ in range(20)])
    at = first
    while at < last:
        symbol = bits.symbol(code)
        if symbol in (17, 18):
            n, value = (bits.take(4) + 4, 0) if symbol == 17 else (bits.take(5) + 20, 0)
        elif symbol == 19:
            n = bits.take(1) + 4
            value = (lengths[at] - bits.symbol(code)) % 17
        else:
            n, value = 1, (lengths[at] - symbol) % 17
        n = min(n, last - at)
        lengths[at : at + n] = [value] * n
        at += n


def lzx_decode(data: bytes, size: int, reset: int, window_bits: int) -> bytes:
    """``size`` plain bytes of an LZX stream whose state begins anew every ``reset`` bytes."""
    if not 15 <= window_bits <= 21:
        raise ArchiveError("unknown window size")
    # Distances: 4 slots of one, then two slots for each number of extra bits up to 17.
    extra = [0, 0, 0, 0, *(k // 2 - 1 for k in range(4, 36)), *([17] * 15)]
    base = [0]
    for k in extra[:-1]:
        base.append(base[-1] + (1 << k))
    slots = next(k for k, b in enumerate(base) if b >= 1 << window_bits)
    bits, out = _Bits(data), bytearray()
    while len(out) < size:
        if len(out) % reset == 0:
            recent, left = [1, 1, 1], 0
            main, lens = [0] * (256 + 8 * slots), [0] * 249
            if bits.take(1):
                raise ArchiveError("translated executables are not supported")
        goal = min(size, (len(out) // FRAME + 1) * FRAME)
        while len(out) < goal:
            if not left:
                kind, left = bits.take(3), bits.take(24)
                if kind in (1, 2):
                    aligned = _Code([bits.take(3) for _ in range(8)]) if kind == 2 else None
                    _lengths(bits, main, 0, 256)
                    _lengths(bits, main, 256, len(main))
                    _lengths(bits, lens, 0, 249)
                    main_code, lens_code = _Code(main), _Code(lens)
                elif kind == 3:
                    bits.to_word()
                    recent = list(struct.unpack("<3i", bits.raw(12)))
                else:
                    raise ArchiveError("unknown block")
                if not left:
                    raise ArchiveError("empty block")
            if kind == 3:
                n = min(left, goal - len(out))
                out += bits.raw(n)
                left -= n
                continue
            symbol = bits.symbol(main_code)
            if symbol < 256:
                out.append(symbol)
                left -= 1
                continue
            slot, n = divmod(symbol - 256, 8)
            n += 2 + (bits.symbol(lens_code) if n == 7 else 0)
            if slot < 3:
                recent[0], recent[slot] = recent[slot], recent[0]
            else:
                k = extra[slot]
                low = (bits.take(k - 3) << 3 | bits.symbol(aligned)) if aligned and k >= 3 else bits.take(k)
                recent = [base[slot] + low - 2, recent[0], recent[1]]
            back = recent[0]
            if not 0 < back <= len(out):
                raise ArchiveError("distance is past the beginning")
            while n > 0:
                some = out[-back:][:n] if n <= back else out[-back:]
                out += some
                n -= len(some)
                left -= len(some)
        bits.to_word()
    return bytes(out[:size])


class ArchiveSource(DataSource):
    """Entries of archives; see the module."""

    @classmethod
    def name(cls) -> str:
        return "corvello_archive"

    def schema(self) -> str:
        return "path string, name string, section int, offset long, length long, content binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def register(spark) -> None:
    """Make the source known to a session, which has to hand filters to such sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options.get("path", "").removeprefix("file:")
        self.content = str(options.get("content", "false")).lower() == "true"
        self.names: set[str] | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self.names = {f.value} if self.names is None else self.names & {f.value}
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(self.path)) if not os.path.isdir(self.path) else sorted(glob.glob(f"{self.path}/*"))
        return [InputPartition(p) for p in found] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        with open(partition.value, "rb") as f:
            archive = Archive(f.read())
        for e in archive.entries:
            if self.names is None or e.name in self.names:
                yield partition.value, e.name, e.section, e.offset, e.length, archive.read(e) if self.content else None


def safe_target(folder: str, name: str) -> str:
    """Where an entry may be extracted to; a name that leads out of the folder raises."""
    target = os.path.normpath(os.path.join(folder, name.lstrip("/")))
    if not target.startswith(os.path.normpath(folder) + os.sep):
        raise ArchiveError(f"{name} leads out of the folder")
    return target


def extract(entries, folder: str):
    """Write the user-visible entries (name from the root) of a frame with content below ``folder``; (name, ok, error) rows.

    ``folder`` has to be shared by the executors.
    """

    def write(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                try:
                    target = safe_target(folder, name)
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    with open(target, "wb") as f:
                        f.write(content)
                    out.append((name, True, None))
                except (OSError, ArchiveError, TypeError) as e:
                    out.append((name, False, str(e)))
            yield pd.DataFrame(out, columns=["name", "ok", "error"])

    return entries.where("startswith(name, '/') AND NOT endswith(name, '/')").select("name", "content").mapInPandas(write, "name string, ok boolean, error string")


def entries(archives, content: bool = False, names: list[str] | None = None):
    """(path, name, section, offset, length, content) of archives (path, data): the entries called ``names`` or all of them.

    ``content`` says whether entries are read; the compressed section is decoded only if one of them lies there.  An archive
    is one row, whose bytes a task holds.
    """

    def read(batches):
        import pandas as pd

        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["data"], strict=True):
                found = Archive(bytes(data))
                some = [e for e in found.entries if names is None or e.name in names]
                yield pd.DataFrame([(path, e.name, e.section, e.offset, e.length, found.read(e) if content else None) for e in some], columns=["path", "name", "section", "offset", "length", "content"])

    return archives.select("path", "data").mapInPandas(read, "path string, name string, section int, offset long, length long, content binary")


def read(spark, path: str, content: bool = False, names: list[str] | None = None):
    """entries() of the archives at a path or glob of any file system that Spark reads."""
    return entries(spark.read.format("binaryFile").load(path).selectExpr("path", "content AS data"), content, names)


def lzx_stored(plain: bytes, reset: int = 2 * FRAME) -> bytes:
    """An LZX stream of blocks that are stored as they are, one for each ``reset`` bytes."""
    out = b""
    for at in range(0, len(plain), reset):
        block = plain[at : at + reset]
        head = (3 << 24 | len(block)) << 4  # a bit for no translation, three for the kind, 24 for the size; then to a word's end
        out += struct.pack("<HH", head >> 16, head & 0xFFFF) + struct.pack("<3i", 1, 1, 1) + block
    return out


def archive_bytes(files: dict[str, bytes], page: int = 4096, compressed: bool = False) -> bytes:
    """A single-file archive in the directory's order; ``compressed``: what has a name from the root goes into an LZX section."""
    places, sections = {}, [b"", b""]

    def put(name: str, data: bytes, section: int) -> None:
        places[name] = (section, len(sections[section]), len(data))
        sections[section] += data

    low = {c: c + 32 for c in range(65, 91)}
    for name in sorted(files, key=lambda n: (n.translate(low).encode(), n)):
        put(name, files[name], int(compressed and name.startswith("/")))
    if compressed:
        put(STORAGE + "Content", lzx_stored(sections[1]), 0)
        put(STORAGE + "ControlData", struct.pack("<I4s5I", 6, COMPRESSED, 2, 2, 2, 1, 0), 0)
        put(STORAGE + "SpanInfo", struct.pack("<Q", len(sections[1])), 0)
    pages, current = [], b""
    for name in sorted(places, key=lambda n: (n.translate(low).encode(), n)):
        raw = name.encode()
        row = varint(len(raw)) + raw + b"".join(map(varint, places[name]))
        if len(current) + len(row) > page - 0x14 - 2:
            pages.append(current)
            current = b""
        current += row
    pages.append(current)
    body = b"".join((LISTING + struct.pack("<IIii", page - 0x14 - len(p), 0, k - 1, k + 1 if k + 1 < len(pages) else -1) + p).ljust(page, b"\0") for k, p in enumerate(pages))
    directory = (DIRECTORY + struct.pack("<III", 1, 0x54, 10) + struct.pack("<I", page)).ljust(0x2C, b"\0") + struct.pack("<I", len(pages))
    directory = directory.ljust(0x54, b"\0") + body
    head = (HEADER + struct.pack("<II", 3, 0x60)).ljust(0x48, b"\0") + struct.pack("<QQQ", 0x60, len(directory), 0x60 + len(directory))
    return head + directory + sections[0]
