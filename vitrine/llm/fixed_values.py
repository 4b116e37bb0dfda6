"""Fixed values of the pipeline operators."""

#: Names of groups of people, by kind and language; terms of one list may stand for each other in a sentence. Fixed values.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys", "transgender", "nonbinary"],
    ["woman", "man", "girl", "boy"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "mormons", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "mormon", "atheist"],
    ["gay", "lesbian", "bisexual", "straight", "queer"],
    ["black", "white", "asian", "latino", "african", "european", "arab", "indigenous"],
    ["immigrants", "refugees", "foreigners", "travellers", "natives"],
    ["disabled", "deaf", "blind", "elderly", "young"],
    ["frauen", "männer", "mädchen", "jungen"],
    ["muslime", "christen", "juden", "hindus", "buddhisten"],
    ["ausländer", "flüchtlinge", "einwanderer", "migranten"],
    ["femmes", "hommes", "filles", "garçons"],
    ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes"],
    ["immigrés", "réfugiés", "étrangers", "migrants"],
    ["mujeres", "hombres", "niñas", "niños"],
    ["musulmanes", "cristianos", "judíos", "hindúes", "budistas"],
    ["inmigrantes", "refugiados", "extranjeros", "migrantes"],
]

#: Words in class, id and role attributes by what they announce. Fixed values.
ATTRIBUTE_WORDS = {
    "advert": "ad ads advert advertisement advertising adslot sponsor sponsored promo promotion banner".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc sitemap".split(),
    "edge": "header footer masthead topbar colophon copyright contentinfo legal site".split(),
    "side": "sidebar side aside widget widgets related recommended trending popular rail complementary more".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall disclaimer toast dialog".split(),
    "comments": "comment comments reply replies disqus discussion respond reader feedback".split(),
    "social": "share sharing social follow tags byline meta author".split(),
    "form": "form search login register contact button buttons".split(),
    "content": "article content post entry story main body text prose page".split(),
}

#: Elements that stay inside a line of text. Fixed values.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source map area audio video track embed param".split()) | set(
    "math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction".split())
#: Elements without an end tag. Fixed values.
VOID = set("area base br col embed hr img input link meta param source track wbr frame keygen".split())
#: Elements whose start ends an open paragraph. Fixed values.
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
#: Elements that end an open one of the same family. Fixed values.
ENDS_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
            "thead": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tfoot", "tr", "td", "th"}}

#: Spellings that count as the same in licence texts: pattern, replacement. Applied in this order to lower-case text. Fixed values.
SPELLINGS = [
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-commercial", "noncommercial"), ("non-infringement", "noninfringement"),
    ("favour", "favor"), ("honour", "honor"), ("organisation", "organization"), ("authorised", "authorized"), ("judgement", "judgment"), ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("https:", "http:"), ("&", " and "), ("[“”„«»]", " "), ("[’‘`]", "'"),
]

#: Known licence texts and notices: name, whole text. Fixed values.
LICENSE_TEXTS = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("All-Rights-Reserved", "All rights reserved."),
]

#: Licences whose whole text is a file of ``license_texts``. Fixed values.
LICENSE_FILES = "Apache-2.0 BSD-2-Clause BSD-3-Clause CC0-1.0 GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 MPL-2.0 Unlicense".split()

#: Lines that may stand above a whole text. Fixed values.
LICENSE_TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng license"],
    "BSD-2-Clause": ["All rights reserved.", "BSD 2-Clause License", "BSD 2-Clause License\nAll rights reserved.", "Simplified BSD License", "The BSD 2-Clause License"],
    "BSD-3-Clause": ["All rights reserved.", "BSD 3-Clause License", "BSD 3-Clause License\nAll rights reserved.", "New BSD License", "The BSD 3-Clause License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
