"""Ids of words that come again in other forms."""

import public_tokenizers

from gridjobs.llm.word_ids import WordIds


def test_known_stems_are_not_encoded_again(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    words, given, plain = WordIds(path), [], WordIds.lines
    monkeypatch.setattr(WordIds, "lines", lambda self, w, fast: given.extend(w) or plain(self, w, fast))
    texts = ["some plain größe words ", "Some, PLAIN größe! wordS. x1 1, Ωmega", "", None, "Words, ΣΑΣ plain?! some;", "É é é , . ;; plain"]
    for i, t in enumerate([*texts, *texts]):
        want = words.tokenizer.encode(t or "", add_special_tokens=False).ids
        assert list(memoryview(words([t])[0]).cast("I")) == want
        if i == 6:  # the older generation's words are known too
            words.memory.held = words.memory.size + 1
    assert [given.count(w) for w in ("some", "plain", "größe", "words")] == [1, 1, 1, 1]
