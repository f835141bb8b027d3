"""Key derivation and chunk-table encryption (J10, J11, J13), with Spark's own AES-GCM.

The stored form is nonce, tag, ciphertext; Spark's is nonce, ciphertext, tag.
Only chunk tables are encrypted, never payloads.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONCE, TAG = 12, 16


def derive_key(passphrase: Column) -> Column:
    """The 32-byte SHA-256 of a passphrase, unsalted."""
    return F.unhex(F.sha2(passphrase, 256))


def encrypt_table(table: Column, key: Column) -> Column:
    def reorder(sealed: Column) -> Column:
        n = F.octet_length(sealed)
        body = F.substring(sealed, F.lit(NONCE + 1), n - NONCE - TAG)
        return F.concat(F.substring(sealed, 1, NONCE), F.substring(sealed, n - TAG + 1, F.lit(TAG)), body)

    # each evaluation draws another nonce, so the value is bound once
    return F.transform(F.array(F.aes_encrypt(table, key, F.lit("GCM"))), reorder)[0]


def decrypt_table(stored: Column, key: Column) -> Column:
    """The table; a wrong key or damaged bytes are an error, a missing key too."""
    n = F.octet_length(stored)
    sealed = F.concat(F.substring(stored, 1, NONCE), F.substring(stored, F.lit(NONCE + TAG + 1), n - NONCE - TAG), F.substring(stored, NONCE + 1, TAG))
    return F.aes_decrypt(sealed, key, F.lit("GCM"))
