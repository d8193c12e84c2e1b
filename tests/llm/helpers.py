"""What the tests of this folder share."""


def prose(rng, n, syllables="the and ing tion er st ou re"):
    parts = syllables.split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))
