"""Invented prose for the tests."""

WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ly", "ing", "s"]) + str(rng.randrange(30)) for _ in range(n))
