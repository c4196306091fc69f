"""Clients that keep their data in files, so that they work across worker processes."""

import json
import os
import uuid


class Files:
    def __init__(self, options):
        self.dir = options["dir"]

    def query(self, sql, after):
        rows = json.load(open(f"{self.dir}/table.json"))
        return [r for r in rows if after is None or str(r[0]) > str(after)]

    def get(self, key):
        path = f"{self.dir}/key-{key}"
        return open(path).read() if os.path.exists(path) else None

    def set(self, key, value):
        with open(f"{self.dir}/key-{key}", "w") as f:
            f.write(value)

    def search(self, index, query, size, part, parts):
        return [h for i, h in enumerate(json.load(open(f"{self.dir}/{index}.json"))) if i % parts == part][:size]

    def bulk(self, index, documents, ids):
        for i, d in enumerate(documents):
            with open(f"{self.dir}/{index}-{ids[i] if ids else uuid.uuid4().hex}", "w") as f:
                json.dump(d, f)

    def close(self):
        open(f"{self.dir}/closed-{uuid.uuid4().hex}", "w").close()


def files(options):
    return Files(options)


def sqlite(options):
    import sqlite3

    return sqlite3.connect(options["dir"] + "/db.sqlite", timeout=30)
