"""Command line: ``pack [--protocol N] [request.json]`` (or the request on stdin), ``protocol``."""

from __future__ import annotations

import sys

from .errors import EngineError
from .functions.text import canonical_json


def main(argv: list[str]) -> int:
    try:
        if argv[:1] == ["protocol"] and len(argv) == 1:
            from .plans.pack import descriptor

            print(canonical_json(descriptor()))
            return 0
        if argv[:1] != ["pack"]:
            raise EngineError("USAGE", "usage: pack [--protocol N] [request.json] | protocol")
        args, wanted = argv[1:], None
        if args[:1] == ["--protocol"]:
            if len(args) < 2 or not args[1].isdigit():
                raise EngineError("USAGE", "--protocol needs a number")
            wanted, args = int(args[1]), args[2:]
        if len(args) > 1:
            raise EngineError("USAGE", "one request at a time")
        from .plans import pack, request

        most = request.LIMITS["maxRequestBytes"] + 1
        try:
            if args and args[0] != "-":
                with open(args[0], "rb") as f:
                    raw = f.read(most)
            else:
                raw = sys.stdin.buffer.read(most)
        except OSError as error:
            raise EngineError("REQUEST_READ_FAILED", f"cannot read the request: {error.strerror}") from None
        value = request.parse(raw, wanted)
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("gneissflow").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
        print(canonical_json(pack.pack(spark, value)))
        return 0
    except EngineError as error:
        print(canonical_json(error.as_dict()), file=sys.stderr)
        return error.exit_code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
