"""Names, teams and positions brought to one spelling."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Endings that are no part of a name.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")
#: The clubs, codes that are no club, and other sources' spellings of teams and positions.
CLUBS = (
    "ARI", "ATL", "BAL", "BUF", "CAR", "CHI", "CIN", "CLE", "DAL", "DEN", "DET", "GB", "HOU", "IND", "JAX", "KC", "LA", "LAC", "LV", "MIA", "MIN", "NE", "NO", "NYG", "NYJ", "PHI", "PIT",
    "SEA", "SF", "TB", "TEN", "WAS",
)
NO_CLUB = ("FA",)
TEAMS = {
    "LAR": "LA", "JAC": "JAX", "WSH": "WAS", "OAK": "LV", "SD": "LAC", "STL": "LA", "AZ": "ARI", "ARZ": "ARI", "SFO": "SF", "KCC": "KC", "LVR": "LV", "NOS": "NO", "TAM": "TB", "GNB": "GB",
    "NWE": "NE", "NOR": "NO", "SFA": "SF", "CLV": "CLE", "BLT": "BAL", "HST": "HOU",
}
POSITIONS = {"FB": "RB", "HB": "RB", "PK": "K", "DST": "DEF", "D/ST": "DEF"}


@F.pandas_udf(T.StringType())
def _plain(names: pd.Series) -> pd.Series:
    """Compatibility forms without combining marks; the one thing that built-in functions lack."""
    return names.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def normal_name(name: Column, python: bool = True) -> Column:
    """Lower case without accents and suffixes, of a to z, digits and single spaces alone. ``-``, ``_`` and ``/`` split
    words, all else is dropped. Null stays null.

    ``python=False`` drops accented letters and stays in generated code, for sources known to be plain."""
    plain = F.lower(_plain(name) if python else name)
    words = F.split(F.regexp_replace(F.regexp_replace(plain, "[-_/]", " "), "[^a-z0-9 ]", ""), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin("", *SUFFIXES)), " ")


def mapped(c: Column, spelling: Mapping[str, str]) -> Column:
    code = F.upper(F.trim(c))
    table = F.create_map(*[F.lit(x) for pair in spelling.items() for x in pair])
    return F.coalesce(table[code], code)


def team(c: Column) -> Column:
    """The club's code; null for null or empty."""
    return mapped(F.nullif(c, F.lit("")), TEAMS)


def position(c: Column) -> Column:
    """The first position of a list such as ``WR,RB``; null for null or empty."""
    return mapped(F.split(F.nullif(c, F.lit("")), ",")[0], POSITIONS)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))
