"""Row generators as table functions: called from SQL on a table that is partitioned and ordered in the call.

``register_all`` names them in a session: ``index_lines``, ``submission_parts``
and ``sentence_chunks``.  Each sees one partition's rows in order and holds what
is open, never the whole partition.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_RULE = re.compile(r"-+\s*")
_WORD = re.compile(r"[^ \t\n\x0B\f\r]+")


@udtf(returnType="cik string, company string, form string, filed string, file string")
class IndexLines:
    """Fields of an index's lines; what comes before the rule of dashes, and lines that are no entry, are left out.

    SELECT * FROM index_lines(TABLE(t) PARTITION BY file ORDER BY number): t has a column ``line``.
    """

    def __init__(self):
        self.begun = False

    def eval(self, row):
        line = row["line"]
        if line is None:
            return
        if not self.begun:
            self.begun = bool(_RULE.fullmatch(line))
            return
        fields = line.split("|")
        if len(fields) == 5:
            yield tuple(x.strip() for x in fields)


@udtf(returnType="place int, type string, filename string, n_lines int, sha256 string")
class SubmissionParts:
    """The documents of a submission, line by line: place, type, name, and the number and hash of the lines of the text.

    SELECT * FROM submission_parts(TABLE(t) PARTITION BY accession ORDER BY number): t has a column ``line``.
    A document without an end is left out.
    """

    def __init__(self):
        self.place = -1
        self.open = False

    def eval(self, row):
        line = row["line"] or ""
        mark = line.strip().upper()
        if mark == "<DOCUMENT>":
            self.place += 1
            self.open, self.inside, self.fields = True, False, {}
            self.lines, self.digest = 0, hashlib.sha256()
        elif not self.open:
            return
        elif mark == "</DOCUMENT>":
            self.open = False
            yield self.place, self.fields.get("TYPE"), self.fields.get("FILENAME"), self.lines, self.digest.hexdigest()
        elif mark == "<TEXT>":
            self.inside = True
        elif mark == "</TEXT>":
            self.inside = False
        elif self.inside:
            self.lines += 1
            self.digest.update(line.encode() + b"\n")
        elif m := re.match(r"<(\w+)>(.*)", line.strip()):
            self.fields.setdefault(m[1].upper(), m[2].strip())


@udtf(returnType="chunk int, first long, last long, n_words int, text string")
class SentenceChunks:
    """Sentences in their order, packed into chunks of at most ``size`` words; a longer sentence is a chunk of its own.

    SELECT * FROM sentence_chunks(TABLE(t) PARTITION BY doc_id ORDER BY (number), 500): t has the columns ``number`` and ``sentence``.
    Null and empty sentences are left out.
    """

    def __init__(self):
        self.chunk, self.words, self.held, self.bounds = 0, 0, [], None

    def eval(self, row, size: int):
        n = len(_WORD.findall(row["sentence"] or ""))
        if not n:
            return
        if self.held and self.words + n > size:
            yield self._close()
        self.held.append(row["sentence"])
        self.words += n
        self.bounds = (self.bounds or (row["number"], 0))[0], row["number"]

    def terminate(self):
        if self.held:
            yield self._close()

    def _close(self):
        row = (self.chunk, *self.bounds, self.words, " ".join(self.held))
        self.chunk, self.words, self.held, self.bounds = self.chunk + 1, 0, [], None
        return row


def register_all(spark: SparkSession) -> None:
    for name, function in (("index_lines", IndexLines), ("submission_parts", SubmissionParts), ("sentence_chunks", SentenceChunks)):
        spark.udtf.register(name, function)
