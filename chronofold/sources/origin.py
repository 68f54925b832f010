"""What stands between a query and a slow origin: layers of caches, spacing of requests, and paginated searches."""

from __future__ import annotations

import json
import threading
import time
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from chronofold.staging import arrow_file


class Spacing:
    """Requests of one process, at least ``seconds`` apart, whichever threads make them."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.seconds, self.clock, self.sleep = seconds, clock, sleep
        self._lock, self._free = threading.Lock(), float("-inf")

    def wait(self) -> float:
        """Wait for a turn; the time at which it came."""
        with self._lock:
            turn = max(self.clock(), self._free)
            self._free = turn + self.seconds
        if (left := turn - self.clock()) > 0:
            self.sleep(left)
        return turn


class Layers:
    """Layers that are asked in order; what a later one has is put into those before it.

    A layer is (get, put).  ``get`` raises KeyError where the key is not there;
    anything else it raises, such as a refusal, is not taken for a missing key
    and ends the search.
    """

    def __init__(self, *layers: tuple[Callable[[str], bytes], Callable[[str, bytes], None] | None]):
        self.layers = layers

    def get(self, key: str) -> bytes:
        for i, (get, _) in enumerate(self.layers):
            try:
                data = get(key)
            except KeyError:
                continue
            for _, put in self.layers[:i]:
                if put:
                    put(key, data)
            return data
        raise KeyError(key)


def restored(wanted: DataFrame, layers: dict[str, DataFrame], *, key: str, value: str) -> DataFrame:
    """The same for tables: each wanted key with the first layer that has it, and its value there; null where none has."""
    rows = wanted.select(key).distinct()
    for name, layer in layers.items():
        rows = rows.join(layer.select(F.col(key), F.col(value).alias(f"_{name}"), F.lit(True).alias(f"_has_{name}")), key, "left")
    has = [F.col(f"_has_{n}") for n in layers]
    layer, found = F.lit(None).cast("string"), F.lit(None)
    for name, there in reversed(list(zip(layers, has, strict=True))):
        layer, found = F.when(there, F.lit(name)).otherwise(layer), F.when(there, F.col(f"_{name}")).otherwise(found)
    return rows.select(key, layer.alias("layer"), found.alias(value))


class Turns:
    """Turns at an origin that several processes share without talking to each other.

    Time is cut into slots of ``seconds`` and a margin, the same for all by the
    clock; of every ``of`` slots a process has the one with its number, and
    begins a request only within the first margin of it.  So requests of all
    processes together are at least ``seconds`` apart, however late a process
    starts, as long as their clocks agree to within the margin.  Two that run
    under one number (a task that is tried twice at once) are not kept apart.
    """

    def __init__(self, seconds: float, number: int = 0, of: int = 1, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.seconds, self.number, self.of, self.clock, self.sleep = seconds, number, of, clock, sleep
        self.margin = max(0.02, seconds / 10)
        self.slot = seconds + 2 * self.margin
        self._used = None

    def wait(self) -> float:
        """Wait for a turn; the time at which it came."""
        if self.seconds <= 0:
            return self.clock()
        while True:
            now = self.clock()
            slot = int(now // self.slot)
            if slot % self.of == self.number and slot != self._used and now - slot * self.slot < self.margin:
                self._used = slot
                return now
            ahead = slot + 1 + (self.number - slot - 1) % self.of
            self.sleep(max(0.0, ahead * self.slot - now) + 0.001)


def _get(url: str) -> dict:
    """The JSON at an address, of the web or of any store that Arrow can open."""
    if url.startswith(("http://", "https://")):
        with urllib.request.urlopen(url, timeout=60) as reply:  # noqa: S310
            return json.load(reply)
    store, path = arrow_file(url)
    with store.open_input_stream(path) as body:
        return json.loads(body.read())


class _Pages(InputPartition):
    """Every ``of``-th page from ``number`` on, of the pages from ``first`` up to ``end``."""

    def __init__(self, number: int, of: int, first: int, end: int):
        super().__init__(number)
        self.number, self.of, self.first, self.end = number, of, first, end


class _Origin:
    """Requests at a paged origin, spaced and tried again."""

    def __init__(self, options: dict):
        self.url, self.size = options["url"], int(options.get("size", 100))
        self.every, self.tries, self.tasks = float(options.get("every", 0)), int(options.get("tries", 3)), int(options.get("tasks", 4))
        if self.size < 1 or self.tasks < 1 or self.tries < 1:
            raise ValueError("size, tasks and tries are at least one")

    def turns(self, number: int = 0) -> Turns:
        """The driver has the slot after those of the tasks."""
        return Turns(self.every, number, self.tasks + 1)

    def fetch(self, start: int, turns: Turns) -> dict:
        for attempt in range(self.tries):
            turns.wait()
            try:
                return _get(self.url.format(page=start // self.size, start=start, size=self.size))
            except OSError:
                if attempt + 1 == self.tries:
                    raise
        raise AssertionError

    def total(self) -> int:
        return int(self.fetch(0, self.turns(self.tasks))["total"])

    def share(self, first: int, end: int) -> list[InputPartition]:
        return [_Pages(i, self.tasks, first, end) for i in range(min(self.tasks, end - first))]


class _Search(_Origin, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        """Pages that the first one's total asks for, dealt out to the tasks."""
        return self.share(0, max(1, -(-self.total() // self.size)))

    def read(self, partition: _Pages) -> Iterator[tuple]:
        turns = self.turns(partition.number)
        for number in range(partition.first + partition.number, partition.end, partition.of):
            page = self.fetch(number * self.size, turns)
            yield number, int(page["total"]), page.get("relation", "eq"), [str(x) for x in page["ids"]]


class PagedSearch(DataSource):
    """``spark.read.format("paged_search")``: a row for each page of a search that answers with total, relation and ids.

    Options: ``url`` with {page}, {start} and {size}; ``size`` of a page;
    ``tasks`` that ask at the same time; ``every``, the least seconds between
    any two requests, of all tasks and the driver together (see ``Turns``);
    ``tries``.  ``readers.page_checks`` tells whether the pages fit together.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return "page int, total long, relation string, ids array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _Search(self.options)


class _Feed(_Origin, DataSourceStreamReader):
    """The offset is the number of items that are read; it stands in the stream's checkpoint."""

    def initialOffset(self) -> dict:
        return {"items": 0}

    def latestOffset(self) -> dict:
        return {"items": self.total()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.bounds = (start["items"], end["items"])
        if self.bounds[0] >= self.bounds[1]:
            return []
        made = self.share(start["items"] // self.size, -(-end["items"] // self.size))
        for p in made:
            p.bounds = self.bounds
        return made

    def read(self, partition: _Pages) -> Iterator[tuple]:
        turns, (low, high) = self.turns(partition.number), partition.bounds
        for number in range(partition.first + partition.number, partition.end, partition.of):
            start = number * self.size
            ids = self.fetch(start, turns)["ids"][max(0, low - start) : high - start]
            if len(ids) != min(high, start + self.size) - max(low, start):
                raise ValueError(f"page {number} of the feed has lost items")
            for place, item in enumerate(ids, max(low, start)):
                yield place, str(item)

    def commit(self, end: dict) -> None:
        """The checkpoint is all that is kept."""


class PolledFeed(DataSource):
    """``spark.readStream.format("polled_feed")``: a row (place, id) for each item of a feed that only grows at its end.

    Options as for ``PagedSearch``.  Each trigger asks the feed for its total;
    what is new since the last one is read page by page.  A batch that is tried
    again reads the same places, so nothing is lost; a page that has fewer items
    than it had is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "polled_feed"

    def schema(self) -> str:
        return "place long, id string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Feed(self.options)
