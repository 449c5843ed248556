"""New units are encoded in one call, and a batch mostly fits its first sharing out."""

import base64
import random

import public_tokenizers
import tiktoken

from dockspan.llm import packing


def encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own.encode_ordinary, ranks


def test_joined_units_are_encoded_as_alone_in_few_calls():
    encode, ranks = encoding()
    asked = []

    def seen(text):
        asked.append(text)
        return encode(text)

    some = random.Random(3)
    words = ["".join(some.choice("abé日1!'s\n") for _ in range(some.randint(1, 9))) for _ in range(500)]
    units = list(dict.fromkeys([" " + w for w in words] + words[:5] + [" ", "", " \n", " x\n", "  a", "\x85"]))
    for own in (units, [u for u in units if u[:1] == " " and u.strip() == u[1:] != ""]):
        ids, lengths = packing.JoinedUnits(seen, ranks)(own)
        expected = [encode(u) for u in own]
        assert lengths.tolist() == [len(x) for x in expected]
        assert ids.tolist() == [i for x in expected for i in x]
    assert len(asked) < len(units) / 2


def test_a_batch_leaves_room_for_its_first_sharing_out(monkeypatch):
    some = random.Random(5)
    tries = []
    inner = packing.differencing
    monkeypatch.setattr(packing, "differencing", lambda sizes, windows: tries.append(windows) or inner(sizes, windows))
    pieces, windows = [], 48
    while sum(pieces) < (2048 - packing.ROOM) * windows - 2048:
        pieces += [x for x in packing.cut(some.randint(1, 6000), 2048, 32) if x < 2048]
    while sum(pieces) > (2048 - packing.ROOM) * windows:
        pieces.pop()
    own = packing.share_out(pieces, 2048)
    assert len(tries) == 1 and len(own) == len(pieces)
