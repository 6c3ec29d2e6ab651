"""Digests of the canonical forms (``licenses.with_digest``) of complete standard license texts, in their common variants.

Variants: with and without what follows the terms ("How to apply"), the addresses the publisher has had, other title lines.
Taken from texts in /usr/share/common-licenses and in packages that carry them.
"""

from __future__ import annotations

# SHA-256 of the canonical forms.
STANDARD = {
    "Apache-2.0": (
        "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b",
        "67e045953182c77acf9892dc3fa8b7556ce97344f311dc27b8f03c0fdc8e23f2",
        "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64",
        "d1680110962921dbea774fa14dfc28da11388743b12bc17fe0c77170a67c3a72",
        "db01d7bc2aa55ff18671fe237b4562bbd8a2a68239c7b8f45f5617bbd1379bf0",
        "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe",
    ),
    "Artistic-1.0-Perl": (
        "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    ),
    "Artistic-2.0": (
        "ef673bda60ff86d93e435501b0dd59d8122a19f7be90131e61d4ce6c5054a465",
    ),
    "BSD-3-Clause": (
        "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",
    ),
    "CC-BY-SA-4.0": (
        "4dd2d8faa991a43111f73718974d1a9133ba1453cd76d174da75d163e35fa974",
    ),
    "CC0-1.0": (
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
        "a142ae38742c8c4c35f5fa19e0a40ebfa60fc38535daf9c570ca3d7e012e1e32",
    ),
    "EPL-2.0": (
        "8fbb910251c24acd487b634ceb37457ff21d40aef11bed21e8bfa194397787e9",
    ),
    "GFDL-1.2": (
        "31d1e54824dc6954a36d4d6510f749ab693be943260bc59079362a26ad74ea17",
        "774142f7f9d180b719ac1fe23dfba3589d91276d948e4dd116cb8811cec60691",
        "915561db8eb69b9193eeb710593d298365e0c52787feb731c684977d5b417af7",
        "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60",
    ),
    "GFDL-1.3": (
        "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826",
    ),
    "GPL-1.0": (
        "2360a1b8fc5b5a8b1db5f560a193fbbc23ee8a553de375a1c8fcc5805d683848",
        "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",
        "6ca08526ee81355436001f14a8806abe1b624bd69c193bcb74e2abc8e629ade5",
        "71fa4bd5fde166ce4fa896f8698e1bcf77024e8a262598b2ea4d3bcad7b6812f",
        "7b86297a2762700b078231c8b488809b0f63cac5e298d74f4270d251bbef230f",
        "858bb219a7a780439b4bc4b70a09728cb4a536c4609a75c282fdaf69c8a85201",
        "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70",
        "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
        "98c96304603be152968c123e484f744c9b51ebd341914aee6eea5c39133891e1",
        "a87d2335c7c408f93c15dd6892a723a61b2645ff1ad65619233239cce6bd570d",
        "ac9f80a0d38a1e001427acb1e9fa5f9a23aee35e40ee2759901306fd4e382697",
        "c0734228e33375b72256fed50d8056b50049dff71f408765af98cd4384a7434a",
        "efcbd5d5f621ec465277efcb03890a7fae6d9253e17b05ef7d7c6f90729a0fc9",
    ),
    "GPL-2.0": (
        "001115645c0e1fff99634cb7aa4697c369faa0a7b54d81a64fe73344f8541761",
        "031ce0347a7bfaa9fea9fb34dc0def0f70d366e9b6aeab50cf9537178d0d9d50",
        "063a635792d7cd0cc271a856ca6adc2cf4ed5852784729b63bcb2a08e0badeb6",
        "10c5ccfff21d19122e63d737c7fe1ddb9c84bd38919c41b679933587e1bbec2f",
        "10d6d4a881dc27025b4564797b656d82470e5aea3e421cbfb50274f9e25a4579",
        "1188bd946c8b086fe6ea384131bc5e4725728e74e0fe1902762c9c87ec4bd36a",
        "1205db3afc4cdc4e3f7e6321383e8fb55af868ab2ec72ddf38e68788be77aa97",
        "1787126a73c2b76e11cec89feac75a548b9a2c6c14c30648bdeea7e2233b7293",
        "1c597e4f5a433be3e767a47b1afa26494fbadcb80dca3c654cffc01a32976de7",
        "204354f4ce2c7d402ca9ad1c08c91b4301b495a0769207c9817a1e1536f3dab2",
        "2223ea95cb62f49852180d174f9e9769c26f6532bee41027cfb4f5256aa51727",
        "2a696343776023a75d7214c5061cecc39f0c7fb07137e2ad49127256c70f3eb5",
        "2abe4f2f5ebff4aa8ed567a0cea0b9820cd074d9d7eda91d90df08701b51faa2",
        "2d5106d375402f83b041785ad1b9925ed45196d448c7db5889cf8d50aece384b",
        "2dddfb21baee920dbbc3d75228da3d2104eb54e673ef5f867ab4495e23c974fc",
        "3417af4a4eb07583be14c0185e9a1834057e320931de2c5bf39c217a03fe79a0",
        "3f6302b11b06e2ba13b2ac80ac77a1979662ab69ce0b459e03a0238dd35d3518",
        "41326808ad324a2d0a7d92184ee37e7903e2f17ceda2f0bdb2610155d8ab5cd9",
        "417e800e7fd34292e96f28ba91c8080a4502d314a20935675860580402e8372b",
        "42a2063beecb82de51a227e52a22e4acf4fa0d052827262e6bb57835e02e10e9",
        "4948fa828dc5fa8f2b6e21675d0b87f69246ec652dad983fcc63200a6ceab35b",
        "495877256ecdef82618fbdecb4b93ffbb12ad21a4e2ea8c5ad51cfe666eb14de",
        "4b03a493f9db80bfdfa7efda8364960a0845705dce78653bf29d7dff25136063",
        "514d1f1365a0f1696a1b5589785f7ab60347bd25f7f0b4a0fe84968c3849cd78",
        "58f387b55eb95a9c5a6ef16e9064e1bfa9420a69181c677ee6eddf6ed1397cfd",
        "5bebeb5e4d4f3d09b7c000a53921f727b78a102a534eaa6fc1ed411f80d90f7f",
        "5cb6370ac80145bff27a54858e51a973da8c42e030e5803cfe2c3953ae0150ac",
        "60337b30a58e450be2a99c6b2cba9832635176b8124745722ec527d590c313b2",
        "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808",
        "71abf7661764a2828c440a74f1f6734789db55257e3049bf14ff6535cfaeaf1d",
        "765649880cdff92fe5ac36da2f80c5d70533878beda24dba289f983bd3913453",
        "78e9c9f811bd1ba04ed6d619d3e51a759305d2f124cee9defa3535ba4a24bd25",
        "88883014c1fe63c13c3188405e7c425b67cc7cb087c7fa51f694dbfb6976bc8e",
        "8c1c2994cc30a83607e645d0c7bfe94908618dbc8797ce927cf2fe8ebf674752",
        "8d49e1561a05df6bf8391bb608bb6b0afb1f66e5ef08ef6ab65c20f0d7a8fde8",
        "9555c62622acb278352b7c073fa29510ab32280a86dfa9f464c147b2930471f0",
        "9bd057847abcffd3f15185fad140e3672c126a542d4849381ab82e33384d56a1",
        "a2ed1590f9f89f7caf54835073a934e5967b6c06917731972efccbe43b09ff01",
        "a6feb63b33a8edbd960f568d1de736ddb819bc39c1e9393850c2705a980c2964",
        "a83735e3cda0f940b58b0f6916fe433880a1fc18f8d5768d023f0ed777d8259d",
        "aa997bc1c3422ccdc7ccabdc6f9aaa9ce2ebeed7be208887d2b13ff901326c75",
        "ab0135b1f1143279a7dd3fc38c13676af6df5a2dd0b2778c9247c5a35513e136",
        "acaf68e303fe7610fff5b930bace57b87821d132bc434f4a104512da48f8bb6c",
        "b1abfb46077acd6c0450274e16fe4cb4610ec546c090c5977a069c5f74340774",
        "ba8b5323b72bf2f2c5d07074133b38292e0fa23fde8fa48771ba8a04cccacddd",
        "bdf38469899e13b914cf4555a4606ddcc8b2faddcedc662286f649b36212f225",
        "c2eea7a9d82a254e540a96d8107801d93d00bcef2742a78b7e8e8d0c0efcbd1c",
        "d111d1c24a44c987fb91de3ce5aab3ec35d8061a2c8a41ffaa8bb64c47df6960",
        "dcd7b97a58f002cca117b733640dd811ce0436beab20bbe888234d58c6198aec",
        "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
        "e249f505e62dffe815578ec3db5a6db73656b478c8009135cab65e1168f7dc96",
        "e92f1fb18f85245a26c26118f0f9fffa2938ca691a90033b02a7648f9cead700",
        "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
        "f92f6b27807b99ffbf23f04cb87d90959e3f9e05ebe2bbdf65d7fa1625cbbe91",
        "fa018088949688fec4a0e0da398be570e8a52dfe1c787fd7cbd4f23416c23d8b",
        "fa10355caa2c96a2bcf18851cef6bc0b289fdcf81d12bc5bc328a1b2a1964413",
    ),
    "GPL-3.0": (
        "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191",
        "9faf4f9b13ca844eeee37346a77dec74f558096ac2b418782a99c8afe4c772da",
        "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",
        "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    ),
    "LGPL-2.0": (
        "084782a05c82d5e85c704f06bab601971e84b3b9b90a51c95ffcff2b342d9cf2",
        "09bda551cd6a1058f0e9053b4e2fcc0bfb193e8bb1e1485734c5113235b4a30d",
        "0e3c184176a70698802350b8f697a92e908601a66f8f622e8d4c08c9e90e0a8f",
        "2652838d994cbfd49626674c95d3dd21f6f86da9dcd7b97e2a33347147ba5323",
        "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2",
        "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",
        "5ce88337a2fce97b0f2b6aac63afc49927c0dc31e15bf530a83e603e1d298d8b",
        "5d55350b4669490b0e66370e797e3ad2b94c2f2df83fc528f03e4ef706914e73",
        "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
        "8e1ec403722434c2951c2e88e9802906c46d9e8bfa59fc4a50fa127211918f01",
        "bdb969a377f6160f4ad0ed61171a77004650a9c2517d62828be29f35b6bf6b31",
        "c7de4b21da394bbb98407cbdd151af9fe43076eccce5ecd393e12a1eb70a3bfc",
        "cbc927caf696ef44b2fbebe29ffa45a5fccf0a64c78f2b85678a11032ebb3318",
        "d40504a2bf1a1a86ee76e642ced31126577d21774b1ac0a222ce730ec78d7108",
        "dc842683831d008ff5f32600206cfd765e4d05df71fe831b1b4b31462fa2fff1",
        "feb45efa998ac9d6ca85b1b2b7dfb124a14b1e88f579d2de38fe3a7970ce7380",
    ),
    "LGPL-2.1": (
        "0de2e3ba00ed5f309ce9d71663e50ea414063f6e46865f2d80d4ad038f268c87",
        "1d2a09e288311515cd0682b55db758224412a4901ca0578bf16420229d5190c4",
        "3bde1ca18489d8594a2c0c04b5ae1003c1795d1680675f4ef758325e1e1c3169",
        "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
        "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
        "4f163e21ac81a5bb5b92c19ede75a32428e1338af052850b5a7c1162f56ca800",
        "5c42345581e1857951a2f5c540eae7981a9540e2d41028f448a195bb48dd33f0",
        "5db6a0cf025514ea4a904dd0c2731b3a48aec5259d5f1ec782685806040d7b6a",
        "925c28788af11361f32b5b10dbeb4454be64e8448ed4a7c0926618a5d8a85bfb",
        "a5ac783c64dc7fa3fe7b641692ee7b8da491bd87f613c9bb99618a9469e71c47",
        "bd06b7347431b0fc243c0e32d1668ab362329b4a591386570abd310334f6fbdb",
        "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df",
        "df8b7d554d9ba4683d95046dc0cd8fdf6c063841a3cfabcf242ab40e69237421",
        "e8379077377b4f1cf6d306654dca012e99fec5e9a13474071c353ba3557fc48b",
        "e8569a0bd486071c6889615f7a331a9c15914f9f684e92e729d2b90d5bed08f9",
    ),
    "LGPL-3.0": (
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ),
    "MPL-1.1": (
        "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b",
    ),
    "MPL-2.0": (
        "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
    ),
}
