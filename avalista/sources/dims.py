"""Dimension tables: sectors, states, banks, and target shares.

All of them are constants of at most 32 rows, so joins may broadcast them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Sector code, name, share, base default rate, volatility.
SECTORS = [
    ("00", "No especificado", None, None, None),
    ("11", "Agricultura, ganadería, pesca", 0.02, 0.09, "alta"),
    ("21", "Minería", 0.01, 0.07, "alta"),
    ("22", "Generación de energía", 0.005, 0.03, "baja"),
    ("23", "Construcción", 0.08, 0.11, "alta"),
    ("31", "Manufactura - Alimentos", 0.06, 0.05, "baja"),
    ("32", "Manufactura - Textil/Química", 0.04, 0.07, "media"),
    ("33", "Manufactura - Metálica/Maquinaria", 0.05, 0.06, "media"),
    ("43", "Comercio al por mayor", 0.08, 0.06, "media"),
    ("46", "Comercio al por menor", 0.35, 0.08, "media"),
    ("48", "Transporte", 0.04, 0.08, "alta"),
    ("51", "Información en medios", 0.02, 0.05, "media"),
    ("52", "Servicios financieros", 0.02, 0.03, "baja"),
    ("53", "Servicios inmobiliarios", 0.03, 0.07, "alta"),
    ("54", "Servicios profesionales", 0.05, 0.04, "baja"),
    ("56", "Servicios de apoyo", 0.04, 0.06, "media"),
    ("61", "Servicios educativos", 0.02, 0.03, "baja"),
    ("62", "Servicios de salud", 0.03, 0.03, "baja"),
    ("71", "Esparcimiento/Cultura", 0.02, 0.10, "alta"),
    ("72", "Alojamiento/Alimentos", 0.12, 0.12, "alta"),
    ("81", "Otros servicios", 0.06, 0.08, "media"),
]

# State code, name, share, development tier.
STATES = [
    ("AGS", "Aguascalientes", 0.013, "high"),
    ("BC", "Baja California", 0.025, "high"),
    ("BCS", "Baja California Sur", 0.006, "medium"),
    ("CAM", "Campeche", 0.007, "low"),
    ("CDMX", "Ciudad de México", 0.062, "high"),
    ("CHIH", "Chihuahua", 0.028, "high"),
    ("CHIS", "Chiapas", 0.042, "low"),
    ("COAH", "Coahuila", 0.021, "high"),
    ("COL", "Colima", 0.008, "medium"),
    ("DGO", "Durango", 0.016, "medium"),
    ("GRO", "Guerrero", 0.035, "low"),
    ("GTO", "Guanajuato", 0.055, "medium"),
    ("HGO", "Hidalgo", 0.026, "low"),
    ("JAL", "Jalisco", 0.065, "high"),
    ("MEX", "Estado de México", 0.127, "medium"),
    ("MIC", "Michoacán", 0.048, "low"),
    ("MOR", "Morelos", 0.019, "medium"),
    ("NAY", "Nayarit", 0.010, "low"),
    ("NL", "Nuevo León", 0.040, "high"),
    ("OAX", "Oaxaca", 0.045, "low"),
    ("PUE", "Puebla", 0.067, "medium"),
    ("QRO", "Querétaro", 0.020, "high"),
    ("QROO", "Quintana Roo", 0.015, "medium"),
    ("SIN", "Sinaloa", 0.027, "medium"),
    ("SLP", "San Luis Potosí", 0.030, "medium"),
    ("SON", "Sonora", 0.025, "high"),
    ("TAB", "Tabasco", 0.022, "low"),
    ("TAM", "Tamaulipas", 0.032, "medium"),
    ("TLAX", "Tlaxcala", 0.012, "low"),
    ("VER", "Veracruz", 0.069, "low"),
    ("YUC", "Yucatán", 0.016, "medium"),
    ("ZAC", "Zacatecas", 0.014, "low"),
]

# Bank, share.
BANKS = [
    ("BBVA México", 0.22), ("Banorte", 0.18), ("Santander México", 0.15),
    ("Citibanamex", 0.12), ("HSBC México", 0.08), ("Scotiabank México", 0.06),
    ("Banco Azteca", 0.05), ("Inbursa", 0.04), ("BanBajío", 0.03),
    ("Banregio", 0.025), ("Afirme", 0.02), ("Banco del Bajío", 0.015),
    ("Multiva", 0.01), ("Banca Mifel", 0.01),
]

# Expected share by company size.
SIZE_SHARES = [("Micro", 0.95), ("Pequeña", 0.035), ("Mediana", 0.012), ("Grande", 0.003)]

# Expected share by number of employees within micro companies.
MICRO_EMPLOYEE_SHARES = [
    (1, 0.20), (2, 0.18), (3, 0.15), (4, 0.12), (5, 0.10),
    (6, 0.08), (7, 0.07), (8, 0.05), (9, 0.03), (10, 0.02),
]

# Amount band, term in months, expected share within the band.
TERM_SHARES = [
    ("<200K", 6, 0.15), ("<200K", 12, 0.35), ("<200K", 18, 0.25), ("<200K", 24, 0.25),
    ("200K-500K", 12, 0.20), ("200K-500K", 18, 0.25), ("200K-500K", 24, 0.30), ("200K-500K", 36, 0.25),
    ("500K-2M", 24, 0.20), ("500K-2M", 36, 0.35), ("500K-2M", 48, 0.30), ("500K-2M", 60, 0.15),
    (">=2M", 36, 0.15), (">=2M", 48, 0.25), (">=2M", 60, 0.30), (">=2M", 84, 0.20), (">=2M", 120, 0.10),
]

# Loan terms on offer, in months.
TERMS = [6, 12, 18, 24, 36, 48, 60, 84, 120]

SECTOR_CODES = [s[0] for s in SECTORS]
STATE_CODES = [s[0] for s in STATES]
BANK_NAMES = [b[0] for b in BANKS]


def constant_table(spark: SparkSession, rows, names) -> DataFrame:
    """A handful of literal rows; planned as a local relation, so its size is known."""
    columns = list(zip(*rows))
    return spark.createDataFrame(pa.table(dict(zip(names, [pa.array(c) for c in columns]))))


def dim_sectors(spark: SparkSession) -> DataFrame:
    return constant_table(spark, SECTORS, ["sector_code", "sector_name", "sector_share", "base_rate", "volatility"])


def dim_states(spark: SparkSession) -> DataFrame:
    return constant_table(spark, STATES, ["state_code", "state_name", "state_share", "tier"])


def dim_banks(spark: SparkSession) -> DataFrame:
    return constant_table(spark, BANKS, ["bank_name", "bank_share"])


def target_shares(spark: SparkSession, dimension: str) -> DataFrame:
    """Target weights (key, weight) of one dimension, not yet normalised.

    ``term`` has two keys: the amount band and the term within it.
    """
    if dimension == "term":
        return constant_table(spark, TERM_SHARES, ["amount_band", "key", "weight"])
    rows = {
        "state": [(s[0], s[2]) for s in STATES],
        "sector": [(s[0], s[2]) for s in SECTORS if s[2] is not None],
        "bank": BANKS,
        "size": SIZE_SHARES,
        "micro_employees": MICRO_EMPLOYEE_SHARES,
    }
    if dimension not in rows:
        raise ValueError(f"unknown dimension {dimension!r}")
    return constant_table(spark, rows[dimension], ["key", "weight"])
