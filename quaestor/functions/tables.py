"""Table functions for SQL: dates of a text, mails of a file, members of an archive, messages of a mailbox given line by line.

``register`` makes them known to a session: ``SELECT id, d.* FROM docs, LATERAL dates(text) d``.  A null argument gives no rows.
"""

from __future__ import annotations

import email
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from quaestor.functions import timeline
from quaestor.sources import files


@udtf(returnType="start int, end int, event_date string, precision string, confidence double", useArrow=True)
class Dates:
    def eval(self, text: str) -> Iterator[tuple]:
        if text is not None:
            yield from timeline.dates(text)


@udtf(returnType="message_id string, subject string, from_name string, from_addr string, date string, body string", useArrow=True)
class Mails:
    def eval(self, path: str, content: bytes) -> Iterator[tuple]:
        if path is not None and content is not None:
            for record in files.mails_of(path, bytes(content)):
                yield (*record[1:5], record[7], record[8])


@udtf(returnType="name string, method string, pages int, text string", useArrow=True)
class Members:
    def eval(self, path: str, content: bytes) -> Iterator[tuple]:
        if path is not None and content is not None:
            yield from files.text_of(path.rsplit("/", 1)[-1], bytes(content))


@udtf(returnType="path string, number int, subject string, from_addr string, body string")
class Mailbox:
    """Messages of mailboxes whose lines are rows (path, line) in order: ``mailbox(TABLE(lines) PARTITION BY path ORDER BY number)``.

    One message at a time is held, however long the mailbox is.
    """

    def __init__(self):
        self.path, self.number, self.lines, self.blank = None, 0, None, True

    def _message(self) -> Iterator[tuple]:
        if self.lines is not None:
            self.number += 1
            record = files.mail_record(self.path, email.message_from_string("\n".join(self.lines)))
            yield self.path, self.number, record[2], record[4], record[8]

    def eval(self, row: Row) -> Iterator[tuple]:
        self.path, line = row["path"], row["line"] or ""
        if self.blank and line.startswith("From "):
            yield from self._message()
            self.lines = []
        elif self.lines is not None:
            self.lines.append(line[1:] if line.lstrip(">").startswith("From ") and line.startswith(">") else line)
        self.blank = not line

    def terminate(self) -> Iterator[tuple]:
        yield from self._message()


def register(spark: SparkSession) -> None:
    for name, function in (("dates", Dates), ("mails", Mails), ("members", Members), ("mailbox", Mailbox)):
        spark.udtf.register(name, function)
