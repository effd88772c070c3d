"""Media columns: interleaved document sequences with digest-resolved payloads.

``parse_sequences`` turns HTML into one ordered array per document of text and media-reference structs, each with its
position; a reference has the digest its ``src`` names and the caption of its figure, so captions stay with their
media. ``resolve`` joins references to a media table by digest. ``encode_texts`` stores any text losslessly as 8-bit
samples: its UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are the pixels of a binary greyscale map
(PGM) 64 samples wide.

Defined results: null HTML or text is empty (an empty text is 64 zero samples); a reference without a known digest
keeps its place with null payload columns; media that repeat a digest count once; documents that repeat are sequences of
their own; empty tables give none; other columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import escape, unescape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, stored, table

WIDTH = 64
#: ``src`` of a medium that is known by its content.
DIGEST_SRC = re.compile(r"digest:sha256-([0-9a-f]{64})$")

ELEMENT = "struct<position:int,kind:string,text:string,src:string,digest:string,caption:string>"
#: Elements whose content isn't shown. ``head`` needs no rule: it holds nothing else, closed or not.
HIDDEN = frozenset({"script", "style", "template", "noscript", "title"})
MEDIA = frozenset({"img", "video", "audio", "source", "embed"})
#: Elements whose end tag also ends what was left open inside them.
CONTAINERS = HIDDEN | {"html", "body", "div", "section", "article", "main", "nav", "aside", "header", "footer", "ul", "ol", "table", "blockquote", "figure", "figcaption"}
BLOCKS = frozenset(
    {"p", "div", "section", "article", "main", "nav", "aside", "header", "footer", "ul", "ol", "li", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "figure", "figcaption", "br", "hr", "body"}
)


#: The name of a tag, one attribute with what stands before it, and the end of a tag.
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:'([^']*)'|"([^"]*)"|(?!['"])([^\s>]*)))?""")
OPEN_QUOTE = re.compile(r"""\s*=\s*['"]""")
TAG_END = re.compile(r"[\s/]*>")
#: Elements whose content is text up to their end tag.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style")}


class SequenceParser:
    """Collects elements in document order. A caption belongs to every medium of its figure, before or after it.

    Any text parses, in time linear in its length: an end tag closes whatever was left open inside its element, one
    without an open element is ignored, and the end of the text closes the rest, so captions and figures end where what
    holds them ends. A tag, a quoted value or a comment that the text doesn't end takes the rest of the text with it, as
    browsers have it, so nothing is looked for twice.
    """

    def __init__(self):
        self.elements: list[dict] = []
        self.text: list[str] = []
        self.open: list[str] = []
        self.count: Counter[str] = Counter()
        self.hidden = 0
        self.figures: list[dict] = []
        #: Open captions, the innermost last, and what is said in those of figures that are shown.
        self.captions: list[tuple[dict, list[str]] | None] = []
        self.told: list[list[str]] = []

    def feed(self, html: str) -> None:
        i, n = 0, len(html)
        while i < n:
            at = html.find("<", i)
            at = n if at < 0 else at
            if at > i:
                self.handle_data(unescape(html[i:at]))
            if at == n:
                return
            if html.startswith("<!--", at):
                end = html.find("-->", at + 2)
                i = end + 3 if end >= 0 else n
            elif html.startswith(("<!", "<?"), at):
                end = html.find(">", at)
                i = end + 1 if end >= 0 else n
            elif name := NAME.match(html, at + 2) if html.startswith("</", at) else None:
                end = html.find(">", name.end())
                if end < 0:
                    return
                self.handle_endtag(name[0].lower())
                i = end + 1
            elif name := NAME.match(html, at + 1):
                i = self.tag(html, name)
            else:
                self.handle_data("<")
                i = at + 1

    def tag(self, html: str, name: re.Match) -> int:
        """Where the text goes on after a start tag, and after what a script or a style holds."""
        tag, i, attrs = name[0].lower(), name.end(), []
        while not (end := TAG_END.match(html, i)):
            found = ATTRIBUTE.match(html, i)
            if not found or OPEN_QUOTE.match(html, found.end()):
                return len(html)
            value = next((v for v in found.groups()[1:] if v is not None), None)
            attrs.append((found[1].lower(), value and unescape(value)))
            i = found.end()
        if end[0].endswith("/>"):
            self.handle_startendtag(tag, attrs)
            return end.end()
        self.handle_starttag(tag, attrs)
        if tag not in RAW:
            return end.end()
        closed = RAW[tag].search(html, end.end())
        return closed.start() if closed else len(html)

    def said(self) -> list[str]:
        return self.told[-1] if self.told else self.text

    def flush(self) -> None:
        """A block begins or ends: words before and after it are apart."""
        if self.told:
            self.said().append(" ")
            return
        said = " ".join("".join(self.text).split())
        self.text = []
        if said:
            self.elements.append({"kind": "text", "text": said, "src": None, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if not self.hidden and (tag in BLOCKS or tag in MEDIA):
            self.flush()
        if tag in CONTAINERS:
            self.open.append(tag)
            self.count[tag] += 1
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "figure":
            self.figures.append({"media": [], "caption": None})
        elif tag == "figcaption":
            self.captions.append((self.figures[-1], []) if self.figures and not self.hidden else None)
            if self.captions[-1]:
                self.told.append(self.captions[-1][1])
        elif tag in MEDIA and not self.hidden:
            named = dict(attrs)
            src = named.get("src")
            if src:
                known = DIGEST_SRC.match(src)
                self.elements.append({"kind": "media", "text": None, "src": src, "digest": known and known[1], "caption": named.get("alt")})
                if self.figures:
                    self.figures[-1]["media"].append(self.elements[-1])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in HIDDEN:  # else it holds nothing
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in CONTAINERS:
            while self.count[tag]:
                if self.end_innermost() == tag:
                    break
        if not self.hidden and tag in BLOCKS:
            self.flush()

    def end_innermost(self) -> str:
        tag = self.open.pop()
        self.count[tag] -= 1
        if tag in HIDDEN:
            self.hidden -= 1
            return tag
        if not self.hidden and tag in BLOCKS:
            self.flush()
        if tag == "figcaption":
            caption = self.captions.pop()
            if caption:
                self.told.pop()
            if caption and caption[0]["caption"] is None:
                caption[0]["caption"] = " ".join("".join(caption[1]).split())
        elif tag == "figure":
            figure = self.figures.pop()
            for medium in figure["media"]:
                medium["caption"] = figure["caption"] if figure["caption"] is not None else medium["caption"]
        return tag

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.said().append(data)

    def finish(self) -> list[dict]:
        while self.open:
            self.end_innermost()
        self.flush()
        return [{"position": i, **e} for i, e in enumerate(self.elements)]


def sequence_of(html: str) -> list[dict]:
    parser = SequenceParser()
    parser.feed(html)
    return parser.finish()


def parse_sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(doc_id, elements): the ordered elements of each page."""

    def rows(got: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, html in got:
            yield doc_id, sequence_of(html or "")

    return map_rows(pages.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{html_col}`")), rows, f"doc_id long, elements array<{ELEMENT}>")


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """One row per element: (doc_id, position, kind, text, src, digest, caption, and ``media``'s other columns as a struct).

    ``media`` has a ``digest`` and whatever columns are wanted: it is reduced to one row per digest before the join, so
    no digest, however often it is referred to, multiplies rows.
    """
    others = [c for c in media.columns if c != "digest"]
    once = media.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in others])).alias("medium"))
    elements = sequences.select("doc_id", F.explode("elements").alias("e")).select("doc_id", "e.*")
    return elements.join(once, "digest", "left").select("doc_id", "position", "kind", "text", "src", "digest", "caption", "medium")


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def to_pgm(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_pgm(media: bytes) -> bytes:
    head = re.match(rb"P5\n(\d+) (\d+)\n255\n", media)
    samples = media[head.end() :]
    if len(samples) != int(head[1]) * int(head[2]):
        raise ValueError("the map's size differs from its samples")
    return samples


def encode_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, media, html): each text's medium and a small document that shows it."""

    def rows(got: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in got:
            data = (text or "").encode()
            payload = padded(data)
            digest = hashlib.sha256(payload).hexdigest()
            title = "" if doc_id is None else escape(str(doc_id))
            yield doc_id, digest, to_pgm(payload), f'<article><p>document {title}</p><figure><img src="digest:sha256-{digest}"><figcaption>{len(data)} bytes</figcaption></figure></article>'

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, "doc_id long, digest string, media binary, html string", batch_rows=500)


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """What the stored bytes of (digest, media) give: sizes, checksums and the samples' mean, deviation and a 64-bit profile."""

    def rows(got: Iterator[tuple]) -> Iterator[tuple]:
        for digest, stored_form in got:
            payload = from_pgm(stored_form)
            samples = np.frombuffer(payload, np.uint8)
            counts = np.bincount(samples, minlength=256)
            n, levels = len(samples), np.arange(256)
            mean = int(counts @ levels) / n
            spread = max(0.0, int(counts @ levels**2) / n - mean * mean) ** 0.5
            column_sums = np.add.reduce(samples.reshape(-1, WIDTH), axis=0, dtype=np.int64)
            profile = np.packbits(column_sums * WIDTH > column_sums.sum()).tobytes().hex()
            yield digest, n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored_form), hashlib.sha256(stored_form).hexdigest(), f"mean={mean:.4f};sd={spread:.4f};profile={profile}"

    return map_rows(media.select("digest", "media"), rows, FEATURES)


def media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence of every page: how many elements, texts, media and captions, and a digest of them all in order."""
    elements = F.col("elements")
    n = lambda condition: F.size(F.filter(elements, condition)).cast("long")
    told = F.transform(elements, lambda e: F.concat_ws("|", e["kind"], F.coalesce(e["text"], e["src"]), F.coalesce(e["caption"], F.lit(""))))
    return parse_sequences(table(spark, sf_dir, "pages")).select(
        F.col("doc_id").alias("page_id"), F.size(elements).cast("long").alias("n_elements"), n(lambda e: e["kind"] == "text").alias("n_texts"), n(lambda e: e["kind"] == "media").alias("n_media"), n(lambda e: e["caption"].isNotNull()).alias("n_captions"),
        F.sha2(F.array_join(told, "\n").cast("binary"), 256).alias("sequence_sha256"),
    )


def op1_media(spark, sf_dir: str) -> DataFrame:
    held = stored(encode_texts(table(spark, sf_dir, "documents")), "media")
    shown = resolve(parse_sequences(held, "doc_id", "html"), media_features(held)).where("kind = 'media'")
    n_bytes = F.regexp_extract("caption", r"^(\d+) bytes$", 1).cast("long").alias("n_bytes")
    return shown.select("doc_id", n_bytes, "medium.*", "position")
