"""Licence notices: whole texts where the folder licences has them, standard headers and one-line forms.

A * stands before a word that must be aligned for the licence to be named, a + before one that must
also follow the word before it in the text, as versions and variants do.
"""

from __future__ import annotations

import pkgutil

_GNU = {
    "GPL-1.0": ("+General", "1"), "GPL-2.0": ("+General", "2"), "GPL-3.0": ("+General", "3"), "LGPL-2.0": ("+Library +General", "2"),
    "LGPL-2.1": ("+Lesser +General", "2.+1"), "LGPL-3.0": ("+Lesser +General", "3"), "AGPL-3.0": ("+Affero +General", "3"),
}
_CC = {"BY": "+Attribution", "BY-SA": "+Attribution-+ShareAlike", "BY-NC": "+Attribution-+NonCommercial", "BY-ND": "+Attribution-+NoDerivatives", "BY-NC-SA": "+Attribution-+NonCommercial-+ShareAlike", "BY-NC-ND": "+Attribution-+NonCommercial-+NoDerivatives"}
#: Files of whole texts, with the words of their titles that tell them from others.
_FILES = {
    "Apache-2.0": ("Apache-2.0", "Apache License Version 2.0", "*Apache License Version *2.0"), "CC0-1.0": ("CC0-1.0", "CC0 1.0 Universal", "*CC0 1.0 Universal"),
    "GPL-1.0": ("GPL-1", "GNU GENERAL PUBLIC LICENSE Version 1", "GNU +GENERAL PUBLIC LICENSE Version +1"), "GPL-2.0": ("GPL-2", "GNU GENERAL PUBLIC LICENSE Version 2", "GNU +GENERAL PUBLIC LICENSE Version +2"),
    "GPL-3.0": ("GPL-3", "GNU GENERAL PUBLIC LICENSE Version 3", "GNU +GENERAL PUBLIC LICENSE Version +3"), "LGPL-2.0": ("LGPL-2", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2", "GNU +LIBRARY GENERAL PUBLIC LICENSE Version +2"),
    "LGPL-2.1": ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1", "GNU +LESSER GENERAL PUBLIC LICENSE Version +2.+1"), "LGPL-3.0": ("LGPL-3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3", "GNU +LESSER GENERAL PUBLIC LICENSE Version +3"),
    "MPL-1.1": ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1", "*MOZILLA PUBLIC LICENSE Version *1.+1"), "MPL-2.0": ("MPL-2.0", "Mozilla Public License Version 2.0", "*Mozilla Public License Version *2.0"),
    "GFDL-1.2": ("GFDL-1.2", "GNU Free Documentation License Version 1.2", "GNU Free *Documentation License Version *1.+2"), "GFDL-1.3": ("GFDL-1.3", "GNU Free Documentation License Version 1.3", "GNU Free *Documentation License Version *1.+3"),
}
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS'
_BSD_2 = """Redistribution and use in source and *binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = "\n3. *Neither the name of the copyright holder nor the names of its contributors may be used to *endorse or *promote products derived from this software without specific prior written permission."
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_OWN = {
    "Apache-2.0": ["Licensed under the *Apache License, Version *2.0.", 'Licensed under the *Apache License, Version *2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "BSD": ["*Redistribution and use in source and *binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-2-Clause": [_BSD_2 + _BSD_END, "released under the *BSD +2-+Clause License."],
    "BSD-3-Clause": [_BSD_2 + _BSD_3 + _BSD_END, "released under the *BSD +3-+Clause License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under *CC0 1.0."],
    "EPL-1.0": ["This program and the accompanying materials are made available under the terms of the *Eclipse Public License +v1.0 which accompanies this distribution"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the *Eclipse Public License *2.0 which is available at", "This program and the accompanying materials are made available under the terms of the *Eclipse Public License *v2.0"],
    "ISC": ['Permission to use, copy, modify, and/or distribute this software for any purpose with or without *fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'],
    "MIT": ["Released under the *MIT License.", "Permission is hereby granted, free of charge, to any person *obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", f'Permission is hereby granted, free of charge, to any person *obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS} OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'],
    "MPL-1.1": ['The contents of this file are subject to the *Mozilla Public License Version *1.+1 (the "License"); you may not use this file except in compliance with the License.'],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the *Mozilla Public License, v. *2.+0."],
    "Unlicense": [f"This is free and *unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_AS_IS} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", "This is free and *unencumbered software released into the public domain."],
}


def all_notices() -> dict[str, list[str]]:
    found = {name: list(forms) for name, forms in _OWN.items()}
    for name, (words, version) in _GNU.items():
        found[name] = [
            f"This work is licensed under the GNU {words} Public License, version +{version}.",
            f"This work is licensed under the GNU {words} Public License *v{version}.",
            f"released under the GNU {words} Public License, version +{version}.",
            f"released under the GNU {words} Public License *v{version}.",
            f"you can redistribute it and/or modify it under the terms of the GNU {words} Public License as published by the Free Software Foundation, either version +{version} of the License",
        ]
    for kind, words in _CC.items():
        for version, where in (("4.+0", "International"), ("3.+0", "Unported")):
            found[f"CC-{kind}-{version.replace('+', '')}"] = [f"Licensed under *CC {' '.join('+' + k for k in kind.split('-'))} +{version}.", f"This work is licensed under a *Creative Commons {words} +{version} {where} License."]
    for name, (file, title, marked) in _FILES.items():
        text = " ".join((pkgutil.get_data(__package__, f"licences/{file}.txt") or b"").decode().replace("*", " ").replace("+", " ").split())
        if title not in text:
            raise ValueError(f"no title in {file}")
        found.setdefault(name, []).append(text.replace(title, marked, 1))
    return found


def identifiers(names: list[str]) -> dict[str, list[str]]:
    """The tags that name a licence by its identifier."""
    return {name: ["*SPDX-License-Identifier: " + " ".join("+" + part for part in name.replace(".", "-").split("-"))] for name in names if name != "BSD"}


#: Names that licences go by besides their titles, in the same marks.
_NAMES = {
    "MIT": ["*MIT +License", "*MIT +Licence", "*Expat +License"],
    "Apache-2.0": ["*Apache +License +2.+0", "*Apache +License +Version +2.+0", "*Apache +License +v2", "*Apache +2.+0", "*ASL +2.+0"],
    "BSD-2-Clause": ["*BSD +2-+Clause", "*2-+Clause +BSD", "*Simplified +BSD +License", "*FreeBSD +License"],
    "BSD-3-Clause": ["*BSD +3-+Clause", "*3-+Clause +BSD", "*New +BSD +License", "*Modified +BSD +License", "*Revised +BSD +License"],
    "CC0-1.0": ["*CC0 +1.+0"],
    "EPL-1.0": ["*Eclipse +Public +License +1.+0", "*Eclipse +Public +License +v1.+0", "*Eclipse +Public +License +Version +1.+0", "*EPL +1.+0"],
    "EPL-2.0": ["*Eclipse +Public +License +2.+0", "*Eclipse +Public +License +v2.+0", "*Eclipse +Public +License +Version +2.+0", "*EPL +2.+0"],
    "ISC": ["*ISC +License", "*ISC +Licence"],
    "MPL-1.1": ["*Mozilla +Public +License +1.+1", "*Mozilla +Public +License +Version +1.+1", "*MPL +1.+1"],
    "MPL-2.0": ["*Mozilla +Public +License +2.+0", "*Mozilla +Public +License +Version +2.+0", "*MPL +2.+0"],
    "Unlicense": ["*The +Unlicense"],
}


def titles(names: list[str]) -> dict[str, list[str]]:
    """Short names of licences, which a text uses instead of a notice, and the fields of package descriptions that hold an identifier."""
    found = {name: list(forms) for name, forms in _NAMES.items()}
    for name, (words, version) in _GNU.items():
        short = name.split("-")[0]
        found[name] = [f"*GNU {words} +Public +License +v{version}", f"*GNU {words} +Public +License +version +{version}", f"*{short}v{version}", f"*{short} +v{version}", f"*{short} +version +{version}"]
        if "." not in version:
            found[name] += [f"*GNU {words} +Public +License +{version}.+0", f"*{short} +{version}.+0"]
        else:
            found[name] += [f"*GNU {words} +Public +License +{version}", f"*{short} +{version}"]
    for kind, words in _CC.items():
        for version in ("4.+0", "3.+0"):
            found[f"CC-{kind}-{version.replace('+', '')}"] = [f"*CC {' '.join('+' + k for k in kind.split('-'))} +{version}", f"*Creative +Commons {words} +{version}"]
    for name, tag in identifiers(names).items():
        found.setdefault(name, []).append("*license " + tag[0].split(": ", 1)[1])
    return found
