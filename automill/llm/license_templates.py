"""Notices of well-known licences, by which ``license_scan`` finds them."""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    """A licence's words, and phrases of them that must stand where the text has them, give or take ``slack`` words."""

    label: str
    text: str
    keys: tuple[str, ...]
    slack: int = 8


def phrase(label: str, text: str) -> Template:
    """A template whose words all stand next to one another."""
    return Template(label, text, (text,), 0)


# Names of licences, and wordings that their owners ask for.
BASE = (
    phrase("mit", "mit license"),
    phrase("apache", "apache license"),
    phrase("gpl", "general public license"),
)

NOTICES = (
    Template("mit-grant", "released under the mit license", ("released under the mit license",), 0),
    Template("mit-grant", "licensed under the mit license", ("licensed under the mit license",), 0),
    Template(
        "mit-grant",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("licensed under the apache license", "version 2 0"), 2),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2"), 2),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3"), 2),
    Template(
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation",
        ("you can redistribute it and or modify it under the terms of", "published by the free software foundation"),
    ),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",), 2),
    Template("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",), 2),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met redistributions of source code must retain the above copyright notice",
        ("redistribution and use in source and binary forms", "must retain the above copyright notice"),
    ),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("subject to the terms of the mozilla public license", "v 2 0"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify and or distribute this software", "with or without fee is hereby granted"),
    ),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("boost-1.0", "distributed under the boost software license version 1 0", ("boost software license", "version 1 0"), 2),
    Template("cc0-1.0", "released under the creative commons cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("licensed under cc by 4 0",), 0),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("licensed under cc by sa 4 0",), 0),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("licensed under cc by nc 4 0",), 0),
    Template("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ("licensed under cc by nc sa 4 0",), 0),
    Template(
        "cc-by-4.0",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution 4 0 international",),
    ),
)
