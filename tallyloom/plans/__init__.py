"""The registered queries of the library, and DuckDB SQL for those that SQL can express."""

from . import more, queries, wired

QUERIES = {**queries.QUERIES, **more.QUERIES, **wired.QUERIES}
SQL = {**queries.SQL, **more.SQL, **wired.SQL}
