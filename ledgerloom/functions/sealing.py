"""Personal fields under AES-GCM: keys derived on the driver, a fresh nonce for each value.

A key is a literal of the plan, so plans of jobs that seal or open fields belong with the
secrets.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of the derivation; bytes of a key, a salt and a nonce.
ROUNDS = 100_000
KEY_BYTES = 32
SALT_BYTES = 16
NONCE_BYTES = 12


def new_salt() -> str:
    return base64.b64encode(os.urandom(SALT_BYTES)).decode()


def derive_key(secret: str, salt: str) -> bytes:
    """A 256-bit key from a secret and a salt in base64, by PBKDF2 with SHA-256."""
    return hashlib.pbkdf2_hmac("sha256", secret.encode(), base64.b64decode(salt), ROUNDS, KEY_BYTES)


def seal(value: Column, key: bytes) -> Column:
    """Envelope (iv, ciphertext) in base64 of a value as text; null stays null."""
    sealed = F.aes_encrypt(value.cast("string"), F.lit(key), F.lit("GCM"))
    # bound once, as each evaluation draws another nonce
    envelopes = F.transform(
        F.array(sealed),
        lambda s: F.when(
            s.isNotNull(),
            F.struct(
                F.base64(F.substring(s, 1, NONCE_BYTES)).alias("iv"),
                F.base64(F.substr(s, F.lit(NONCE_BYTES + 1))).alias("ciphertext"),
            ),
        ),
    )
    return F.get(envelopes, F.lit(0))


def unseal(envelope: Column, key: bytes) -> Column:
    """The text of an envelope; null for a null one, another key's or an altered one."""
    sealed = F.concat(F.unbase64(envelope["iv"]), F.unbase64(envelope["ciphertext"]))
    return F.try_aes_decrypt(sealed, F.lit(key), F.lit("GCM")).cast("string")


def seal_fields(df: DataFrame, fields: Sequence[str], key: bytes) -> DataFrame:
    """The rows with these columns replaced by their envelopes; the others stay as they are."""
    return df.withColumns({name: seal(F.col(f"`{name}`"), key) for name in fields})
