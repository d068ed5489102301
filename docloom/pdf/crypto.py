"""Standard security handler: RC4 and AES by the published standard, revisions 2 to 6."""

from __future__ import annotations

import hashlib
import os
import struct
from functools import lru_cache

import numpy as np

from docloom.pdf.syntax import DocError

#: Fixed value: the padding string of the standard.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i, k in enumerate((key * (256 // len(key) + 1))[:256]):
        x = s[i]
        j = (j + x + k) & 255
        s[i] = s[j]
        s[j] = x
    out, i, j = bytearray(), 0, 0
    for c in data:
        i = (i + 1) & 255
        x = s[i]
        j = (j + x) & 255
        y = s[i] = s[j]
        s[j] = x
        out.append(c ^ s[(x + y) & 255])
    return bytes(out)


def _times(a: int, b: int) -> int:
    p = 0
    while b:
        if b & 1:
            p ^= a
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return p


def _sbox() -> list[int]:
    """Inverse in the field of 256 elements, then the affine map."""
    box = [0] * 256
    for x in range(256):
        inv = next((y for y in range(1, 256) if _times(x, y) == 1), 0)
        r = inv
        for k in range(1, 5):
            r ^= (inv << k | inv >> (8 - k)) & 255
        box[x] = r ^ 0x63
    return box


class Aes:
    """The block cipher: words through combined tables to encrypt, all blocks at once to decrypt."""

    _box: list[int] = []
    _mix: list[list[int]] = []
    _unbox = np.zeros(0, np.uint8)
    _unmul: dict[int, np.ndarray] = {}

    def __init__(self, key: bytes):
        if not Aes._mix:
            box = _sbox()
            column = [(_times(s, 2), s, s, _times(s, 3)) for s in box]
            # Table k: a byte's substitute times the mixing column, turned by k places.
            Aes._mix = [[int.from_bytes(bytes(c[(i - k) % 4] for i in range(4))) for c in column] for k in range(4)]
            Aes._unbox = np.argsort(np.array(box)).astype(np.uint8)
            Aes._unmul = {k: np.array([_times(i, k) for i in range(256)], np.uint8) for k in (9, 11, 13, 14)}
            Aes._box = box
        words, n = [key[i : i + 4] for i in range(0, len(key), 4)], len(key) // 4
        self.rounds, rcon = n + 6, 1
        for i in range(n, 4 * (self.rounds + 1)):
            t = words[-1]
            if i % n == 0:
                t = bytes(self._box[b] for b in t[1:] + t[:1])
                t = bytes([t[0] ^ rcon]) + t[1:]
                rcon = _times(rcon, 2)
            elif n > 6 and i % n == 4:
                t = bytes(self._box[b] for b in t)
            words.append(bytes(a ^ b for a, b in zip(words[i - n], t, strict=True)))
        self.words = [int.from_bytes(w) for w in words]

    def encrypt(self, a: int, b: int, c: int, d: int) -> tuple[int, int, int, int]:
        """One block as four words."""
        k, (m0, m1, m2, m3), s = self.words, self._mix, self._box
        a, b, c, d = a ^ k[0], b ^ k[1], c ^ k[2], d ^ k[3]
        for r in range(4, 4 * self.rounds, 4):
            a, b, c, d = (
                m0[a >> 24] ^ m1[b >> 16 & 255] ^ m2[c >> 8 & 255] ^ m3[d & 255] ^ k[r],
                m0[b >> 24] ^ m1[c >> 16 & 255] ^ m2[d >> 8 & 255] ^ m3[a & 255] ^ k[r + 1],
                m0[c >> 24] ^ m1[d >> 16 & 255] ^ m2[a >> 8 & 255] ^ m3[b & 255] ^ k[r + 2],
                m0[d >> 24] ^ m1[a >> 16 & 255] ^ m2[b >> 8 & 255] ^ m3[c & 255] ^ k[r + 3],
            )
        last = lambda w, x, y, z, key: (s[w >> 24] << 24 | s[x >> 16 & 255] << 16 | s[y >> 8 & 255] << 8 | s[z & 255]) ^ key
        k = k[4 * self.rounds :]
        return last(a, b, c, d, k[0]), last(b, c, d, a, k[1]), last(c, d, a, b, k[2]), last(d, a, b, c, k[3])

    def decrypt(self, blocks: np.ndarray) -> np.ndarray:
        """Blocks as rows of 16 bytes."""
        keys = np.array(self.words, ">u4").view(np.uint8).reshape(-1, 16)
        back = np.array([(i - 4 * (i % 4)) % 16 for i in range(16)])
        s = blocks ^ keys[self.rounds]
        m = self._unmul
        for r in range(self.rounds - 1, -1, -1):
            s = self._unbox[s[:, back]] ^ keys[r]
            if r:
                x = s.reshape(-1, 4, 4)
                s = (m[14][x] ^ m[11][np.roll(x, -1, 2)] ^ m[13][np.roll(x, -2, 2)] ^ m[9][np.roll(x, -3, 2)]).reshape(-1, 16)
        return s


def aes_cbc(key: bytes, iv: bytes, data: bytes, decrypt: bool, pad: bool = True) -> bytes:
    cipher = Aes(key)
    if not decrypt and pad:
        n = 16 - len(data) % 16
        data += bytes([n]) * n
    data = data[: len(data) // 16 * 16]
    if decrypt:
        blocks = np.frombuffer(data, np.uint8).reshape(-1, 16)
        out = (cipher.decrypt(blocks) ^ np.concatenate((np.frombuffer(iv[:16], np.uint8)[None], blocks[:-1]))).tobytes() if len(blocks) else b""
        return out[: -out[-1]] if pad and out and 1 <= out[-1] <= 16 else out
    words, last, made = struct.unpack(f">{len(data) // 4}I", data), struct.unpack(">4I", iv[:16]), []
    for i in range(0, len(words), 4):
        last = cipher.encrypt(words[i] ^ last[0], words[i + 1] ^ last[1], words[i + 2] ^ last[2], words[i + 3] ^ last[3])
        made += last
    return struct.pack(f">{len(made)}I", *made)


def file_key(password: bytes, e: dict, file_id: bytes) -> bytes:
    """Key of revisions 2 to 4 from a user password."""
    n = e["length"] // 8 if e["r"] >= 3 else 5
    h = hashlib.md5((password + PAD)[:32] + e["o"][:32] + struct.pack("<i", e["p"]) + file_id + (b"\xff" * 4 if e["r"] >= 4 and not e["metadata"] else b"")).digest()
    if e["r"] >= 3:
        for _ in range(50):
            h = hashlib.md5(h[:n]).digest()
    return h[:n]


def user_value(key: bytes, r: int, file_id: bytes) -> bytes:
    if r == 2:
        return rc4(key, PAD)
    v = rc4(key, hashlib.md5(PAD + file_id).digest())
    for i in range(1, 20):
        v = rc4(bytes(b ^ i for b in key), v)
    return v + bytes(16)


def _owner_key(owner: bytes, r: int, n: int) -> bytes:
    h = hashlib.md5((owner + PAD)[:32]).digest()
    if r >= 3:
        for _ in range(50):
            h = hashlib.md5(h).digest()
    return h[: n if r >= 3 else 5]


@lru_cache(maxsize=64)  # files of one call share their passwords
def owner_value(owner: bytes, user: bytes, r: int, length: int) -> bytes:
    key, v = _owner_key(owner or user, r, length // 8), (user + PAD)[:32]
    for i in range(20 if r >= 3 else 1):
        v = rc4(bytes(b ^ i for b in key), v)
    return v


def user_from_owner(owner: bytes, e: dict) -> bytes:
    return _user_from_owner(owner, e["r"], e["length"], e["o"][:32])


@lru_cache(maxsize=64)
def _user_from_owner(owner: bytes, r: int, length: int, v: bytes) -> bytes:
    key = _owner_key(owner, r, length // 8)
    for i in range(19 if r >= 3 else 0, -1, -1):
        v = rc4(bytes(b ^ i for b in key), v)
    return v


def hash_r6(password: bytes, salt: bytes, extra: bytes, r: int) -> bytes:
    k = hashlib.sha256(password + salt + extra).digest()
    i = 0
    while r >= 6:
        block = aes_cbc(k[:16], k[16:32], (password + k + extra) * 64, False, pad=False)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(block[:16]) % 3](block).digest()
        i += 1
        if i >= 64 and block[-1] <= i - 32:
            break
    return k[:32]


def unlock(e: dict, file_id: bytes, password: bytes) -> bytes:
    """The file key, from a user or an owner password."""
    if e["r"] >= 5:
        pw, o, u = password[:127], e["o"], e["u"]
        if hash_r6(pw, o[32:40], u[:48], e["r"]) == o[:32]:
            return aes_cbc(hash_r6(pw, o[40:48], u[:48], e["r"]), bytes(16), e["oe"][:32], True, pad=False)
        if hash_r6(pw, u[32:40], b"", e["r"]) == u[:32]:
            return aes_cbc(hash_r6(pw, u[40:48], b"", e["r"]), bytes(16), e["ue"][:32], True, pad=False)
        raise DocError("wrong_password")
    for user in (password, user_from_owner(password, e)):
        key = file_key(user, e, file_id)
        if user_value(key, e["r"], file_id)[:16] == e["u"][:16]:
            return key
    raise DocError("wrong_password")


def object_key(key: bytes, num: int, gen: int, aes: bool) -> bytes:
    h = hashlib.md5(key + struct.pack("<I", num)[:3] + struct.pack("<I", gen)[:2] + (b"sAlT" if aes else b"")).digest()
    return h[: min(16, len(key) + 5)]


def apply(key: bytes, e: dict, num: int, gen: int, data: bytes, decrypt: bool, iv: bytes | None = None) -> bytes:
    method = e["method"]
    if method == "Identity":
        return data
    if method == "V2":
        return rc4(object_key(key, num, gen, False), data)
    k = key if method == "AESV3" else object_key(key, num, gen, True)
    if decrypt:
        return aes_cbc(k, data[:16], data[16:], True)
    iv = iv or os.urandom(16)
    return iv + aes_cbc(k, iv, data, False)


def setup(user: bytes, owner: bytes, file_id: bytes, permissions: int = -4, method: str = "AESV3", metadata: bool = True, random=os.urandom) -> tuple[dict, bytes]:
    """A new encryption description and its file key; ``random`` gives salts and keys."""
    if method == "AESV3":
        key = random(32)
        uv, uk, ov, ok = (random(8) for _ in range(4))
        u = hash_r6(user, uv, b"", 6) + uv + uk
        ue = aes_cbc(hash_r6(user, uk, b"", 6), bytes(16), key, False, pad=False)
        o = hash_r6(owner or user, ov, u, 6) + ov + ok
        oe = aes_cbc(hash_r6(owner or user, ok, u, 6), bytes(16), key, False, pad=False)
        perms = aes_cbc(key, bytes(16), struct.pack("<i", permissions) + b"\xff" * 4 + (b"T" if metadata else b"F") + b"adb" + random(4), False, pad=False)
        return {"v": 5, "r": 6, "length": 256, "p": permissions, "o": o, "u": u, "oe": oe, "ue": ue, "perms": perms, "metadata": metadata, "method": method}, key
    r = {"V2": 3, "AESV2": 4}[method]
    e = {"v": 2 if r == 3 else 4, "r": r, "length": 128, "p": permissions, "metadata": metadata, "method": method}
    e["o"] = owner_value(owner, user, r, 128)
    key = file_key(user, e, file_id)
    e["u"] = user_value(key, r, file_id)
    return e, key
